"""Evaluation as aggregates over (y, pred) or (y, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classification(rows: DataFrame) -> DataFrame:
    """One row: accuracy, f1_macro, f1_micro, f1_binary (class 1), from the confusion matrix.

    Classes that occur in neither column do not count; a class without true and predicted rows has 0."""
    m = rows.groupBy("y", "pred").agg(F.count("*").cast("double").alias("n"))
    by = lambda c, name: m.groupBy(F.col(c).alias("k")).agg(F.sum("n").alias(name))
    hit = m.filter("y = pred").select(F.col("y").alias("k"), F.col("n").alias("tp"))
    each = by("y", "pos").join(by("pred", "said"), "k", "full_outer").join(hit, "k", "left").na.fill(0.0, ["pos", "said", "tp"])
    each = each.withColumn("f1", F.try_divide(2 * F.col("tp"), F.col("pos") + F.col("said")))
    acc = F.sum("tp") / F.sum("pos")
    return each.agg(acc.alias("accuracy"), F.avg("f1").alias("f1_macro"), acc.alias("f1_micro"), F.coalesce(F.max(F.when(F.col("k") == 1, F.col("f1"))), F.lit(0.0)).alias("f1_binary"))


def auc(rows: DataFrame) -> DataFrame:
    """Area under the curve of (y in 0/1, score), ties by half: from counts by score, so equal scores are one row."""
    by = rows.groupBy("score").agg(F.sum(F.col("y").cast("double")).alias("p"), F.sum(1 - F.col("y").cast("double")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    area = by.withColumn("a", F.col("p") * (before + F.col("n") / 2))
    return area.agg(F.try_divide(F.sum("a"), F.sum("p") * F.sum("n")).alias("auc"))


def adjusted_rand(rows: DataFrame) -> DataFrame:
    """Adjusted Rand index of (y, pred) from pair counts of the contingency table."""
    m = rows.groupBy("y", "pred").agg(F.count("*").cast("double").alias("n"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = m.agg(F.sum(two("n")).alias("c"), F.sum("n").alias("t"))
    a = m.groupBy("y").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("a"))
    b = m.groupBy("pred").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("b"))
    one = cells.crossJoin(a).crossJoin(b).withColumn("e", F.try_divide(F.col("a") * F.col("b"), F.col("t") * (F.col("t") - 1) / 2))
    return one.select(F.coalesce(F.try_divide(F.col("c") - F.col("e"), (F.col("a") + F.col("b")) / 2 - F.col("e")), F.lit(1.0)).alias("ari"))


def run_statistics(rows: DataFrame) -> DataFrame:
    """(metric, mean, std): over runs, population deviation."""
    return rows.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
