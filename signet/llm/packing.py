"""Packing documents into token sequences by cutting-stock column generation.

Documents longer than a sequence give full sequences first; what is left over is one piece each. The
histogram of left-over lengths, in units of UNIT tokens, is a cutting-stock problem of at most SEQ / UNIT
rows whatever the input: a linear program over patterns, solved by the revised simplex method, whose columns
an unbounded knapsack prices by dynamic programming. Rounded-down patterns take most pieces, and what they
leave (less than one sequence a pattern) is packed first-fit decreasing. The plan goes to the executors as
a few arrays; pieces are ranked within their length and take the pattern's places by rank.

Tokens are made once, in one pass. A tokenizer whose file has the pre-tokenizer PATTERN never joins over white space,
nor Latin letters with ASCII digits or signs, so a text's ids are its pieces' ids in a row, and ids are kept by pieces
of words (told by 64 bits of hash: with a million pieces a worker, a collision has a chance below 1e-7). Any other
tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import Table

SEQ, UNIT, END = 2048, 8, 1
#: Pieces of words a worker keeps the ids of, in arrays of about 40 bytes each; text bytes that are encoded at once.
KEPT_WORDS, AT_ONCE = 500_000, 1 << 20
# The pre-tokenizer and normalizers of files whose texts can be encoded by pieces of words.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Hash buckets by which the pieces of one length are ranked, so that no length is one task.
BUCKETS = 256


def solve(demand: np.ndarray, capacity: int, rounds: int = 20_000) -> list[tuple[np.ndarray, float]]:
    """Patterns and their real multiplicities that cover demand[i] pieces of i + 1 units with least sequences."""
    need = np.flatnonzero(demand > 0)
    if not len(need):
        return []
    sizes, d = need + 1, demand[need].astype(float)
    m = len(sizes)
    cols = np.diag((capacity // sizes).astype(float))
    inverse, x = np.diag(1.0 / np.diag(cols)), d / np.diag(cols)
    for _ in range(rounds):
        y = inverse.sum(axis=0)
        best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes[0]), capacity + 1):
            fit = int(np.searchsorted(sizes, c, "right"))
            v = best[c - sizes[:fit]] + y[:fit]
            k = int(np.argmax(v))
            best[c], take[c] = v[k], k
            if best[c - 1] > best[c]:
                best[c], take[c] = best[c - 1], -2
        if best[capacity] <= 1 + 1e-9:
            break
        a, c = np.zeros(m), capacity
        while c > 0 and take[c] != -1:
            if take[c] == -2:
                c -= 1
                continue
            a[take[c]] += 1
            c -= int(sizes[take[c]])
        w = inverse @ a
        ok = w > 1e-9
        ratio = np.where(ok, x / np.where(ok, w, 1), np.inf)
        r = int(np.argmin(ratio))
        step = ratio[r]
        x = x - step * w
        x[r] = step
        cols[:, r] = a
        pivot = inverse[r] / w[r]
        inverse = inverse - np.outer(w, pivot)
        inverse[r] = pivot
    out = []
    for k in range(m):
        if x[k] > 1e-9:
            full = np.zeros(len(demand), np.int64)
            full[need] = np.rint(cols[:, k]).astype(np.int64)
            out.append((full, float(x[k])))
    return out


def plan(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns, each with its number of sequences, that hold exactly demand."""
    left, out = demand.astype(np.int64).copy(), []
    for pattern, x in solve(demand, capacity):
        used = np.flatnonzero(pattern)
        n = int(min(np.floor(x + 1e-7), (left[used] // pattern[used]).min())) if len(used) else 0
        if n > 0:
            out.append((pattern, n))
            left -= pattern * n
    while left.any():
        pattern, room = np.zeros_like(left), capacity
        for i in range(len(left) - 1, -1, -1):
            k = min(int(left[i] - pattern[i]), room // (i + 1))
            pattern[i] += k
            room -= k * (i + 1)
        used = np.flatnonzero(pattern)
        n = int((left[used] // pattern[used]).min())
        out.append((pattern, n))
        left -= pattern * n
    return out


def places(patterns: list[tuple[np.ndarray, int]], bins: int) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """For each length: first ranks of patterns, their first sequence, and pieces a sequence; then the sequence count."""
    found: dict[int, list[tuple[int, int, int]]] = {i: [] for i in range(bins)}
    used, first = np.zeros(bins, np.int64), 0
    for pattern, n in patterns:
        for i in np.flatnonzero(pattern):
            found[int(i)].append((int(used[i]), first, int(pattern[i])))
            used[i] += pattern[i] * n
        first += n
    return {i: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for i, v in found.items() if v}, first


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): pieces of words that this vocabulary's pre-tokenizer never joins.

    Besides white space it always parts Latin letters from ASCII digits and signs. Words with an apostrophe
    (contractions) or `<` (special tokens) stay whole and keep their case; all others are lower-cased in A-Z.
    """
    starts, ends, _ = W.spans(data, offsets)
    after = np.append(data[1:], 0)
    lead = (data >= 0xC3) & (data <= 0xC5) & ~((data == 0xC3) & ((after == 0x97) | (after == 0xB7)))
    letter = _LETTER[data] | lead
    letter[1:] |= lead[:-1]
    sign = (data < 0x80) & ~letter & ~W.SPACE[data]
    cut = np.flatnonzero((letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])) + 1
    held = np.concatenate([[0], np.cumsum((data == 0x27) | (data == 0x3C))])
    whole = held[ends] > held[starts]
    low = W.LOWER[data]
    for a, b in zip(starts[whole], ends[whole], strict=True):
        low[a:b] = data[a:b]
    word = np.searchsorted(starts, cut, "right") - 1
    # a text's first byte can follow another text's last one without a gap: that is a start already
    cut = cut[(word >= 0) & ~whole[np.maximum(word, 0)] & (starts[np.maximum(word, 0)] < cut)] if len(starts) else cut[:0]
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return low, starts, ends, np.searchsorted(starts, offsets)


def by_words(path: str) -> bool:
    """Whether the tokenizer in a file parts texts as parts() does."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    steps = (held.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = steps[0]
    return (
        first.get("type") == "Split" and first.get("pattern") == {"Regex": PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
        and [n["type"] for n in (held.get("normalizer") or {}).get("normalizers", [])] == NORMALIZERS and all(x.get("add_prefix_space") is False for x in steps[1:])
        and all("<" in t["content"] for t in held["added_tokens"])
    )


class Words:
    """Token ids of pieces of words, kept by hash in sorted arrays that a worker keeps over its tasks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), by_words(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _add(self, keys: np.ndarray, texts: list[str]) -> None:
        found = []
        for lo in range(0, len(texts), 5000):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 5000], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        start = len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]])
        self.ids = np.concatenate([self.ids, np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))])
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.start, self.size = all_keys[order], np.concatenate([self.start, start])[order], np.concatenate([self.size, size])[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, first[i] of text i)."""
        if not self.by_words:
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for own in ids for i in own], np.uint32), np.concatenate([[0], np.cumsum([len(own) for own in ids])]).astype(np.int64)
        low, starts, ends, first = parts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        unique, at, inverse = np.unique(W.word_hashes(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_WORDS:
            self.clear()
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            self._add(unique[new], [low[starts[at[i]] : ends[at[i]]].tobytes().decode("utf-8", "replace") for i in new])
            place = np.searchsorted(self.keys, unique)
        begin, size = self.start[place][inverse], self.size[place][inverse]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[first]


_VOCABULARIES: dict[str, Words] = {}


def vocabulary_of(path: str) -> Words:
    """This worker's vocabulary of a file: words met in one task are known in the next."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Words(path)
    return _VOCABULARIES[path]


def _cutter(path: str, payload: bool):
    names = ["start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches):
        vocabulary = vocabulary_of(path)
        for batch in W.pieces(batches, "text", AT_ONCE):
            ids, first = vocabulary.encode(*W.buffers(batch.column(batch.schema.get_field_index("text"))))
            rows, held = [], []
            for i in range(len(first) - 1):
                own = np.append(ids[first[i] : first[i + 1]], np.uint32(END)).astype("<u4")
                for a in range(0, len(own), SEQ):
                    part = own[a : a + SEQ]
                    rows.append((i, a, len(part), zlib.crc32(part.tobytes()), len(own)))
                    if payload:
                        held.append(part.astype(np.int32))
            cols = np.array(rows, np.int64).reshape(-1, 5)
            more = [pa.array(held, pa.list_(pa.int32()))] if payload else []
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")).take(pa.array(cols[:, 0])), *[pa.array(cols[:, k]) for k in range(1, 5)], *more], ["id", *names, *["ids"] * payload])

    return cut


def sequences(packed: DataFrame, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens) from what pack() gives with payload: SEQ ids each, pad after the last piece.

    A sequence is one group of SEQ ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    whole = parts.select("sequence_id", ids.alias("ids")).withColumn("n_tokens", F.size("ids"))
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), F.lit(SEQ) - F.col("n_tokens"))).alias("ids"), "n_tokens")


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", payload: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with payload also its ids.

    Null and empty texts are the end token alone. Every row of df is a document, also where ids repeat or are
    null. Sequences hold at most SEQ tokens; offsets in a sequence are gapless from 0. An empty table gives none.
    """
    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    cut = narrow.mapInArrow(_cutter(tokenizer, payload), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long{', ids array<int>' * payload}")
    # stored: the plan and the places must see the same pieces, and tokens are made once
    pieces = Table(cut.withColumn("row", F.monotonically_increasing_id()), "pieces").df
    bins = SEQ // UNIT
    key = F.xxhash64("row")
    pieces = pieces.withColumns({"bin": F.when(F.col("length") == SEQ, bins).otherwise(F.ceil(F.col("length") / UNIT) - 1).cast("int"), "key": key}).withColumn("bucket", F.pmod("key", F.lit(BUCKETS)).cast("int"))
    counts = pieces.groupBy("bin", "bucket").agg(F.count("*").alias("n"))
    histogram = np.zeros(bins + 1, np.int64)
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most SEQ / UNIT + 1 rows
        histogram[r["bin"]] = r["n"]
    at, sequences = places(plan(histogram[:bins], bins), bins)
    upto = Window.partitionBy("bin").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("bin", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bin", "bucket").orderBy("key"))
    ranked = pieces.join(before, ["bin", "bucket"]).withColumn("rank", F.col("before") + inside - 1)

    @F.pandas_udf("long")
    def sequence(bin, rank):  # noqa: A002
        out = np.zeros(len(bin), np.int64)
        b, r = bin.to_numpy(), rank.to_numpy()
        for i in np.unique(b):
            own = b == i
            lo, first, per = at[int(i)]
            k = np.searchsorted(lo, r[own], "right") - 1
            out[own] = first[k] + (r[own] - lo[k]) // per[k]
        import pandas as pd

        return pd.Series(out)

    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * payload]
    full = ranked.filter(F.col("bin") == bins).select(*columns, (F.col("rank") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = ranked.filter(F.col("bin") < bins).withColumn("sequence_id", sequence("bin", "rank"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "key").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.select(*columns, "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0).cast("long")).alias("offset"))
    return full.union(rest)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")
