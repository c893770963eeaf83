"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

Two dictionaries are trained from the whole texts of labelled rows, one a class, in samples of BLOCK bytes. A text is compressed, in blocks of
BLOCK bytes that together are the whole text, once with either dictionary; the difference of the two sizes
over their sum says which class's strings it is made of. The mean difference, the least and the greatest of a
block, and the size itself over the bytes (how much a text repeats) enter a logistic calibration that turns
them into a score.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1. The sample is bounded: SAMPLE
labelled ids a class, by hash order, found in the narrow table of labels before any text is read. An id that bears
several texts gives the least of them; an id labelled both good and bad gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Labelled rows of each class that are learnt from, at most; half of them make the dictionaries.
SAMPLE = 3000
DICTIONARY, BLOCK, LEVEL = 65536, 2048, 1
N_FEATURES = 7


def held_out(id_column: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1; null ids are not held out (and carry no label)."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def train_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where the sample is too small to train on, its raw content."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY:]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.pair = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: bytes) -> list[float]:
        """Of a whole text: mean, least and greatest block difference, sizes over bytes, log length, square, share of blocks for the bad class."""
        if not text:
            return [0.0] * N_FEATURES
        cuts = range(0, len(text), BLOCK)
        # a short last block says little on its own and joins the one before it
        blocks = [text[a : a + BLOCK] for a in cuts]
        if len(blocks) > 1 and len(blocks[-1]) < BLOCK // 4:
            blocks[-2:] = [blocks[-2] + blocks[-1]]
        sizes = np.array([[len(c.compress(b)) for c in self.pair] for b in blocks], float)
        raw = np.array([len(b) for b in blocks], float)
        part = (sizes[:, 1] - sizes[:, 0]) / sizes.sum(axis=1)
        good, bad = sizes.sum(axis=0)
        mean = (bad - good) / (bad + good)
        return [10 * mean, 10 * float(part.min()), 10 * float(part.max()), float(np.minimum(good, bad) / raw.sum()) * 4, float(np.log1p(raw.sum()) / 5), 10 * mean * abs(mean) * 10, float((raw * (part < 0)).sum() / raw.sum())]


def _featurer(good: bytes, bad: bytes, extra: tuple[str, ...]):
    def run(batches):
        pair = Compressors(good, bad)
        for batch in W.pieces(batches, "text"):
            data, offsets = W.buffers(batch.column(batch.schema.get_field_index("text")))
            rows = [pair.features(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(len(offsets) - 1)]
            out = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in extra], out], [*extra, "features"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the constant first, means, scales) by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


class Model:
    """What fit() learnt: two dictionaries and a calibration, or a constant where a class has no rows."""

    def __init__(self, good: bytes = b"", bad: bytes = b"", weights: tuple | None = None, constant: float = 0.5):
        self.good, self.bad, self.weights, self.constant = good, bad, weights, constant

    def score(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, score) for each row of df, whole texts; null texts count as empty."""
        kind = df.schema[id_col].dataType.simpleString()
        narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
        if self.weights is None:
            return narrow.select("id", F.lit(self.constant).alias("score"))
        return narrow.mapInArrow(self._scorer(("id",)), f"id {kind}, score double")

    def _scorer(self, extra: tuple[str, ...]):
        w, mean, scale = self.weights
        featurer = _featurer(self.good, self.bad, extra)

        def run(batches):
            for batch in featurer(batches):
                x = np.array(batch.column(len(extra)).to_pylist(), float).reshape(-1, N_FEATURES)
                z = np.clip(w[0] + ((x - mean) / scale) @ w[1:], -30, 30)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(extra)], pa.array(1 / (1 + np.exp(-z)))], [*extra, "score"])

        return run

    def keep(self, df: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
        """The rows of df, all columns, whose score is at least `least`."""
        if self.weights is None:
            return df if self.constant >= least else df.limit(0)
        scorer, schema = self._scorer(("text",)), df.schema

        def run(batches):
            for batch in W.pieces(batches, text_col):
                score = next(scorer(iter([pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(text_col)).fill_null("")], ["text"])]))).column(1)
                yield batch.filter(pa.compute.greater_equal(score, least))

        return df.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from labelled rows that are not held out. Null labels, ids without a text and labels other than
    0 and 1 are left out; without rows of both classes the score is a constant, the share of good rows."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    order = F.xxhash64(F.col("id").cast("string"))
    picked = [known.filter(F.col("y") == y).orderBy(order, "id").limit(sample).collect() for y in (1, 0)]
    chosen = [(r["id"], r["y"], k % 2) for rows in picked for k, r in enumerate(rows)]
    if not all(picked):
        n = [len(p) for p in picked]
        return Model(constant=(n[0] + 1) / (sum(n) + 2))
    spark = docs.sparkSession
    ids = spark.createDataFrame(chosen, f"id {known.schema['id'].dataType.simpleString()}, y int, part int")  # at most 2 * sample rows
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(ids), "id").filter(F.col("text").isNotNull())
    text = text.groupBy("id", "y", "part").agg(F.min("text").alias("text"))  # one text an id: 2 * sample rows at most
    pieces = text.filter("part = 0").select("y", "text", order.alias("o")).orderBy("o", "text").collect()
    by: dict[int, list[bytes]] = {1: [], 0: []}
    for r in pieces:
        raw = r["text"].encode()
        by[r["y"]] += [raw[a : a + BLOCK] for a in range(0, len(raw), BLOCK)]
    if not all(by.values()):
        return Model(constant=(len(by[1]) + 1) / (len(pieces) + 2))
    good, bad = (train_dictionary(by[y]) for y in (1, 0))
    rows = text.filter("part = 1").select("y", "text").mapInArrow(_featurer(good, bad, ("y",)), "y int, features array<double>").collect()
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(constant=(len(by[1]) + 1) / (len(pieces) + 2))
    x = np.array([r["features"] for r in rows], float)
    return Model(good, bad, fit_logistic(x, y))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted), one row for each row of docs; empty tables give none."""
    out = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col).score(docs, id_col, text_col)
    return out.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, labels).withColumnRenamed("id", "doc_id")
