"""What iterations share: rows written to the cluster's checkpoint folder, so that plans stay short and no executor is needed twice."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and kept in spark.checkpoint.dir; where a local session names none, a folder is set, elsewhere that is an error."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="signet-"))
    return df.checkpoint(eager=True)
