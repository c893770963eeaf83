"""Incremental degrees over an edge stream, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signed_degrees(edges: DataFrame, time: str | None = None, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Running (id, row_pos, row_neg) of a stream of edges (src, w); with a time column, by tumbling window and watermark."""
    key = [F.col("src").alias("id")]
    if time is not None:
        edges = edges.withWatermark(time, late)
        key.insert(0, F.window(time, width).alias("window"))
    zero = F.lit(0.0)
    return edges.groupBy(*key).agg(F.sum(F.greatest("w", zero)).alias("row_pos"), F.sum(F.greatest(-F.col("w"), zero)).alias("row_neg"))
