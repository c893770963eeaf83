"""Message passing on long vectors (id, pos, val), and the dense steps between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signet.functions import ACTIVATIONS


def spmm(edges: DataFrame, x: DataFrame, to: str = "dst", w: str = "w") -> DataFrame:
    """out[dst] += w x[src], or with to='src' out[src] += w x[dst]."""
    other = "src" if to == "dst" else "dst"
    return edges.join(x.withColumnRenamed("id", other), other).groupBy(F.col(to).alias("id"), "pos").agg(F.sum(F.col(w) * F.col("val")).alias("val"))


def aggregate(edges: DataFrame, x: DataFrame, how: str = "mean", message=None) -> DataFrame:
    """Messages of the sources (val, or message(val, w)) gathered at the targets by mean, sum, max or min."""
    value = F.col("val") if message is None else message(F.col("val"), F.col("w"))
    fold = {"mean": F.avg, "add": F.sum, "sum": F.sum, "max": F.max, "min": F.min}[how]
    return edges.join(x.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "pos").agg(fold(value).alias("val"))


def dense(x: DataFrame, weight: list[list[float]], bias: list[float] | None = None) -> DataFrame:
    """x W + b: the row of W that belongs to a position is a literal array, spread over the output positions."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in weight])
    spread = x.select("id", "val", F.posexplode(F.element_at(rows, F.col("pos") + 1)).alias("pos", "m"))
    out = spread.groupBy("id", "pos").agg(F.sum(F.col("val") * F.col("m")).alias("val"))
    if bias is None:
        return out
    b = F.array(*[F.lit(float(v)) for v in bias])
    return out.select("id", "pos", (F.col("val") + F.element_at(b, F.col("pos") + 1)).alias("val"))


def activate(x: DataFrame, name: str) -> DataFrame:
    return x.withColumn("val", ACTIVATIONS[name](F.col("val")))


def add(*parts: DataFrame) -> DataFrame:
    """Sum of vectors; places that a part lacks count as 0."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id", "pos").agg(F.sum("val").alias("val"))


def scale(x: DataFrame, by: float | Column) -> DataFrame:
    return x.withColumn("val", F.col("val") * by)


def concat(*parts: tuple[DataFrame, int]) -> DataFrame:
    """Parts (x, width) side by side."""
    out, at = None, 0
    for x, width in parts:
        moved = x.select("id", (F.col("pos") + at).cast("int").alias("pos"), "val")
        out, at = moved if out is None else out.union(moved), at + width
    return out


def softmax(x: DataFrame, log: bool = False) -> DataFrame:
    own = Window.partitionBy("id")
    x = x.withColumn("top", F.max("val").over(own))
    x = x.withColumn("total", F.sum(F.exp(F.col("val") - F.col("top"))).over(own))
    value = F.col("val") - F.col("top") - F.log("total") if log else F.exp(F.col("val") - F.col("top")) / F.col("total")
    return x.select("id", "pos", value.alias("val"))


def argmax(x: DataFrame) -> DataFrame:
    """(id, pos) of the largest value, of equal ones the first."""
    return x.groupBy("id").agg(F.max(F.struct("val", (-F.col("pos")).alias("p"))).alias("m")).select("id", (-F.col("m.p")).alias("pos"))


def l2_normalized(x: DataFrame, least: float = 1e-12) -> DataFrame:
    n = F.sqrt(F.sum(F.col("val") * F.col("val")).over(Window.partitionBy("id")))
    return x.withColumn("n", F.greatest(n, F.lit(least))).select("id", "pos", (F.col("val") / F.col("n")).alias("val"))


def standardized(x: DataFrame) -> DataFrame:
    """Columns less their mean, over their population deviation (1 where that is 0): partial sums, then one row a column."""
    s = x.groupBy("pos").agg(F.avg("val").alias("m"), F.stddev_pop("val").alias("s"))
    return x.join(F.broadcast(s), "pos").select("id", "pos", ((F.col("val") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("val"))


def drop_features(x: DataFrame, prob: float, seed: int = 0) -> DataFrame:
    """Whole columns set to 0, each with the given chance."""
    from signet.functions import uniform

    return x.withColumn("val", F.when(uniform(seed, F.col("pos")) < prob, 0.0).otherwise(F.col("val")))


def dropout(x: DataFrame, prob: float, seed: int = 0) -> DataFrame:
    """Training-time dropout: entries set to 0 with the given chance, others scaled up."""
    from signet.functions import uniform

    return x.withColumn("val", F.when(uniform(seed, F.col("id"), F.col("pos")) < prob, 0.0).otherwise(F.col("val") / (1 - prob)))


def one_hot(labels: DataFrame, classes: int) -> DataFrame:
    """(id, pos, val) from (id, y)."""
    return labels.select("id", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("pos"), "y").select("id", "pos", (F.col("pos") == F.col("y")).cast("double").alias("val"))


def complex_relu(x: DataFrame) -> DataFrame:
    """(id, pos, re, im) kept where re >= 0, else 0 in both parts."""
    keep = F.col("re") >= 0
    return x.select("id", "pos", F.when(keep, F.col("re")).otherwise(0.0).alias("re"), F.when(keep, F.col("im")).otherwise(0.0).alias("im"))


def pair_gather(pairs: DataFrame, x: DataFrame, width: int) -> DataFrame:
    """(src, dst, pos, val): the vectors of both endpoints of each pair, side by side."""
    left = pairs.select("src", "dst").join(x.withColumnRenamed("id", "src"), "src").select("src", "dst", F.col("pos").cast("int").alias("pos"), "val")
    right = pairs.select("src", "dst").join(x.withColumnRenamed("id", "dst"), "dst").select("src", "dst", (F.col("pos") + width).cast("int").alias("pos"), "val")
    return left.union(right)


def pair_dots(pairs: DataFrame, x: DataFrame) -> DataFrame:
    """pairs with `dot`, the product of the endpoints' vectors; each pair is joined to whole vectors once."""
    packed = x.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "val"))).alias("v"))
    a, b = packed.select(F.col("id").alias("src"), F.col("v").alias("va")), packed.select(F.col("id").alias("dst"), F.col("v").alias("vb"))
    both = pairs.join(a, "src").join(b, "dst")
    dot = F.aggregate(F.array_sort(F.map_keys("va")), F.lit(0.0), lambda s, k: s + F.element_at("va", k) * F.coalesce(F.try_element_at(F.col("vb"), k), F.lit(0.0)))
    return both.withColumn("dot", dot).drop("va", "vb")
