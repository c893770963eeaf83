"""Readers of the file formats that graph data sets come in, and a registry of names.

Text formats use Spark's own readers. Binary NumPy archives are opened from the bytes that Spark's binary reader
hands out, so they may lie in any store that Spark reads; a file is one row, as large as one graph.
"""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_appearance(rows: DataFrame, raw: str, order: str, blocks: int = 1024) -> DataFrame:
    """(raw, id): dense ids from 0 in the order in which raw ids first appear.

    First places are found by a partial minimum. Numbers are given in two levels, so no task sees all ids: inside ranges
    of first places (bounds from approximate quantiles of the order's number or time, one range where it has none),
    and over the counts of the ranges. Bounds only deal the rows; the numbers do not depend on them."""
    first = rows.groupBy(raw).agg(F.min(order).alias("__at"))
    kind, key = first.schema["__at"].dataType, F.col("__at")
    if kind.typeName() == "struct":  # the first field orders first
        kind, key = kind[0].dataType, key[kind.fieldNames()[0]]
    if kind.typeName().startswith("timestamp"):
        key = key.cast("timestamp")
    elif kind.typeName() not in ("long", "integer", "double"):
        key = F.lit(0)
    first = first.withColumn("__k", key.cast("double"))
    cuts = first.agg(F.percentile_approx("__k", [(i + 1) / blocks for i in range(blocks - 1)], 10 * blocks)).first()[0]
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts or [0.0]))])
    dealt = first.withColumn("__b", F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi")), lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
        F.when(F.element_at(bounds, F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1) < F.col("__k"), F.struct((F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))), lambda s: s["lo"]))
    upto = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("__b").agg(F.count("*").alias("n")).select("__b", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__at"))
    return dealt.join(F.broadcast(before), "__b").select(raw, (F.col("before") + inside - 1).cast("long").alias("id"))  # at most `blocks` rows


def read_edge_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, id map) of a file of source, target, weight without header; ids by first appearance, source first."""
    lines = spark.read.csv(path, schema="a string, b string, w double", mode="FAILFAST").withColumn("at", F.monotonically_increasing_id())
    seen = lines.select(F.col("a").alias("raw"), (F.col("at") * 2).alias("at")).union(lines.select("b", F.col("at") * 2 + 1))
    ids = first_appearance(seen, "raw", "at")
    named = lines.join(ids.select(F.col("raw").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("raw").alias("b"), F.col("id").alias("dst")), "b")
    return named.select("src", "dst", "w"), ids


def write_id_map(ids: DataFrame, path: str) -> None:
    ids.write.mode("overwrite").json(path)


def read_adjacency_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """edges, features (id, pos, val), labels (id, y) and masks (name, split, id) of a file of links, features, labels and masks."""
    doc = spark.read.json(path, multiLine=True)
    out = {"edges": doc.select(F.posexplode("links").alias("src", "l")).select(F.col("src").cast("long").alias("src"), F.explode(F.col("l").cast("array<long>")).alias("dst"), F.lit(1.0).alias("w"))}
    if "features" in doc.columns:
        out["features"] = doc.select(F.posexplode("features").alias("id", "x")).select(F.col("id").cast("long").alias("id"), F.posexplode("x").alias("pos", "val")).withColumn("val", F.col("val").cast("double"))
    if "labels" in doc.columns:
        out["labels"] = doc.select(F.posexplode("labels").alias("id", "y")).select(F.col("id").cast("long").alias("id"), F.col("y").cast("int").alias("y"))
    masks = []
    for name in ("train_masks", "val_masks", "stopping_masks", "test_mask"):
        if name in doc.columns:
            inner = doc.schema[name].dataType.elementType.typeName() == "array"
            rows = doc.select(F.posexplode(name).alias("split", "m")) if inner else doc.select(F.lit(0).alias("split"), F.col(name).alias("m"))
            masks.append(rows.select(F.lit(name).alias("name"), "split", F.posexplode("m").alias("id", "on")).filter("on").select("name", "split", F.col("id").cast("long").alias("id")))
    if masks:
        whole = masks[0]
        for m in masks[1:]:
            whole = whole.union(m)
        out["masks"] = whole
    return out


def read_node_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(id, x, y) of a file with header: id, comma-joined features, label."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="id long, feature string, label int")
    return rows.select("id", F.transform(F.split("feature", ","), lambda v: v.cast("double")).alias("x"), F.col("label").alias("y"))


def read_edge_tsv(spark: SparkSession, path: str) -> DataFrame:
    """edges of a file with header: source, target; each pair once."""
    return spark.read.csv(path, sep="\t", header=True, schema="src long, dst long").dropDuplicates().withColumn("w", F.lit(1.0))


def _arrays(spark: SparkSession, path: str, schema: str, unpack: Callable) -> DataFrame:
    def run(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(unpack(io.BytesIO(bytes(content))))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_coo_npz(spark: SparkSession, path: str) -> DataFrame:
    """edges of a sparse matrix archive in coordinate (row, col, data) or compressed row form (data, indices, indptr)."""
    def unpack(f):
        import numpy as np

        with np.load(f, allow_pickle=False) as z:
            if "row" in z:
                src, dst = z["row"], z["col"]
            else:
                dst, src = z["indices"], np.repeat(np.arange(len(z["indptr"]) - 1), np.diff(z["indptr"]))
            return {"src": src.astype("int64"), "dst": dst.astype("int64"), "w": z["data"].astype("float64")}

    return _arrays(spark, path, "src long, dst long, w double", unpack).filter("w <> 0")


def read_csr_pair_npz(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """edges, features and labels of an archive with adj_* and attr_* compressed rows and labels."""
    def part(prefix):
        def unpack(f):
            import numpy as np

            with np.load(f, allow_pickle=False) as z:
                pick = {k: z[f"{prefix}{s}{k}"] for k in ("data", "indices", "indptr") for s in (("_" if f"{prefix}_{k}" in z else "."),)}
                rows = np.repeat(np.arange(len(pick["indptr"]) - 1), np.diff(pick["indptr"]))
                return {"a": rows.astype("int64"), "b": pick["indices"].astype("int64"), "v": pick["data"].astype("float64")}

        return _arrays(spark, path, "a long, b long, v double", unpack)

    def labels(f):
        import numpy as np

        with np.load(f, allow_pickle=False) as z:
            return {"id": np.arange(len(z["labels"]), dtype="int64"), "y": z["labels"].astype("int32")}

    return {"edges": part("adj").toDF("src", "dst", "w"), "features": part("attr").selectExpr("a as id", "cast(b as int) as pos", "v as val"), "labels": _arrays(spark, path, "id long, y int", labels)}


def read_dense_npy(spark: SparkSession, path: str) -> DataFrame:
    """edges of a dense square matrix: its entries other than 0."""
    def unpack(f):
        import numpy as np

        m = np.load(f, allow_pickle=False)
        src, dst = np.nonzero(m)
        return {"src": src.astype("int64"), "dst": dst.astype("int64"), "w": m[src, dst].astype("float64")}

    return _arrays(spark, path, "src long, dst long, w double", unpack)


def read_labels_npy(spark: SparkSession, path: str) -> DataFrame:
    def unpack(f):
        import numpy as np

        y = np.load(f, allow_pickle=False).ravel()
        return {"id": np.arange(len(y), dtype="int64"), "y": y.astype("int32")}

    return _arrays(spark, path, "id long, y int", unpack)


def read_masks_npz(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) of boolean arrays train_mask, val_mask and test_mask."""
    def unpack(f):
        import numpy as np

        with np.load(f, allow_pickle=False) as z:
            names = [k for k in ("train_mask", "val_mask", "test_mask") if k in z]
            ids = [np.flatnonzero(z[k]) for k in names]
        return {"name": np.repeat(names, [len(i) for i in ids]), "id": np.concatenate(ids).astype("int64")}

    return _arrays(spark, path, "name string, id long", unpack)


READERS: dict[str, Callable] = {"csv": read_edge_csv, "json": read_adjacency_json, "tsv": read_edge_tsv, "npz": read_coo_npz, "csr-npz": read_csr_pair_npz, "npy": read_dense_npy}


def load(spark: SparkSession, kind: str, path: str, transform: Callable | None = None):
    """What the reader of a kind (in any case) returns, passed through transform if one is given."""
    if kind.lower() not in READERS:
        raise NameError(f"no reader for {kind}; known: {', '.join(READERS)}")
    out = READERS[kind.lower()](spark, path)
    return out if transform is None else transform(out)
