"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z lower-cased, digits as 0, white space collapsed) and hashed; every document gives
each of its distinct lines once, so counting rows by (host, line) counts distinct documents. Lines in more
documents of a host than the limit are removed, and a document that this depletes is rejected. The host is
the document's source.

One pass over the texts writes a narrow row for each document (its figures and line hashes); all joins
run on those. Line counts use partial sums, so a line that a third of all documents share costs one row a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Table

#: A line is removed in hosts where it stands in more documents than both of these allow.
LEAST_DOCS, HOST_SHARE = 20, 0.01
#: A document is depleted if removed lines hold more than this share of its words.
DEPLETED = 0.5
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_NORMAL = W.LOWER.copy()
_NORMAL[0x30:0x3A] = 0x30
_START = np.ones(256, bool)
_START[0x80:0xC0] = False  # bytes that begin a code point

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(batches, texts: bool = False):
    for batch in W.pieces(batches, "text"):
        data, offsets = W.buffers(batch.column(batch.schema.get_field_index("text")))
        starts, ends, first = W.spans(data, offsets)
        exact = W.word_hashes(data, starts, ends)
        normal = W._hashes(_NORMAL[data], starts, ends)
        gap = W.SPACE[data]
        points = np.concatenate([[0], np.cumsum(_START[data] & ~gap)])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        newline = np.flatnonzero(data == 10)
        rows = {k: [] for k in FIGURES}
        lines, line_words = [], []
        for i in range(len(offsets) - 1):
            a, b, lo, hi = first[i], first[i + 1], offsets[i], offsets[i + 1]
            rows["n_words"].append(b - a)
            rows["word_chars"].append(points[hi] - points[lo])
            rows["n_symbols"].append(symbols[hi] - symbols[lo])
            repeat = 0
            grams = W.windows(exact[a:b], WINDOW)
            if len(grams):
                order = np.argsort(grams, kind="stable")
                same = grams[order[1:]] == grams[order[:-1]]
                twice = np.zeros(len(grams), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                if twice.any():
                    edge = np.zeros(b - a + 1, np.int64)
                    at = np.flatnonzero(twice)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + WINDOW, -1)
                    repeat = int((np.cumsum(edge[:-1]) > 0).sum())
            rows["n_repeat_words"].append(repeat)
            # lines with a word: the words between two newlines
            cuts = newline[np.searchsorted(newline, lo) : np.searchsorted(newline, hi)]
            bounds = np.concatenate([[lo], cuts + 1, [hi + 1]])
            word = np.searchsorted(starts[a:b], bounds) + a
            full = np.flatnonzero(word[1:] > word[:-1])
            raw = W._hashes(np.append(data[lo:hi], 10), bounds[full] - lo, bounds[full + 1] - 1 - lo) if len(full) else np.zeros(0, np.uint64)
            rows["n_dup_lines"].append(len(raw) - len(np.unique(raw)))
            keys, inverse = np.unique(W._hashes(normal, word[full], word[full + 1]), return_inverse=True)
            counts = np.bincount(inverse, weights=(word[full + 1] - word[full]).astype(np.float64), minlength=len(keys)) if len(keys) else np.zeros(0)
            lines.append(keys.view(np.int64))
            line_words.append(counts.astype(np.int64))
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int32)
        flat = lambda parts: pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
        keep = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "host", *["text"] * texts)]
        yield pa.RecordBatch.from_arrays([*keep, *[pa.array(np.array(rows[k], np.int64)) for k in FIGURES], flat(lines), flat(line_words)], ["id", "host", *["text"] * texts, *FIGURES, "lines", "line_words"])


def _cut(batches):
    """The batches with `cleaned`: texts without the lines whose normalised hashes are in `gone`."""
    for batch in W.pieces(batches, "text"):
        column = batch.column(batch.schema.get_field_index("text"))
        out = []
        for text, gone in zip(column.to_pylist(), batch.column(batch.schema.get_field_index("gone")).to_pylist(), strict=True):
            if not gone:
                out.append(text)
                continue
            lines = text.split("\n")
            data, offsets = W.buffers(pa.array(lines, pa.string()))
            starts, ends, first = W.spans(data, offsets)
            h = W._hashes(W._hashes(_NORMAL[data], starts, ends), first[:-1], first[1:]).view(np.int64)
            cut = np.isin(h, np.array(gone, np.int64)) & (first[1:] > first[:-1])
            out.append("\n".join(x for x, c in zip(lines, cut.tolist(), strict=True) if not c))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "cleaned"])


def rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = LEAST_DOCS, host_share: float = HOST_SHARE, depleted: float = DEPLETED, payload: bool = False) -> DataFrame:
    """One row for each row of df: id, host, the five figures, removed_words, base_failed, kept; with payload also
    `cleaned`, the text without the removed lines (the other lines as they are).

    Null and empty texts have no words and so fail; a null host is a host of its own; repeated rows count as
    documents of their own. Null ids stay null. An empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.col(f"`{host_col}`").cast("string").alias("host"))
    figures = ", ".join(f"{c} long" for c in FIGURES)
    text = "text string, " if payload else ""
    measured = Table(narrow.mapInArrow(lambda b: _measure(b, payload), f"id {kind}, host string, {text}{figures}, lines array<long>, line_words array<long>").withColumn("row", F.monotonically_increasing_id()), "rules").df
    hosts = measured.groupBy("host").agg(F.count("*").alias("host_docs"))
    # host and line in one 64-bit key, so that a null host needs no join of its own
    line = measured.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "row", "host", F.xxhash64(F.coalesce("host", F.lit("\0")), F.col("l.lines")).alias("line"), F.col("l.lines").alias("hash"), F.col("l.line_words").alias("n"))
    often = line.groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > least_docs)
    often = often.join(hosts, often.host.eqNullSafe(hosts.host)).filter(F.col("docs") > F.col("host_docs") * host_share).select("line")
    hit = line.join(often, "line").groupBy("row")
    removed = hit.agg(F.sum("n").alias("removed_words"), F.collect_list("hash").alias("gone")) if payload else hit.agg(F.sum("n").alias("removed_words"))
    out = measured.drop("lines", "line_words").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    if payload:
        out = out.mapInArrow(_cut, out.withColumn("cleaned", F.lit("")).schema).drop("text", "gone")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= F.col("n_words") * depleted)).drop("row")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return rules(docs).select(F.col("id").alias("doc_id"), *FIGURES, "base_failed", "kept", "removed_words")
