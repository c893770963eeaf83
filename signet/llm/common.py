"""Helpers that every operator of this subpackage shares: durable tables, row hashing, components."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where a local session names none, a temporary folder is set, which is right because driver and
    executors are then one process; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    import tempfile

    path = "file://" + tempfile.mkdtemp(prefix="signet-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/signet/{name}-{uuid.uuid4().hex}"
    _ROOTS.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table through Hadoop's file system layer, wherever it is kept."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of one Arrow batch, where the session has Spark's default: rows here are whole texts.
BATCH_ROWS = 2500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size from Spark's default, so that batches of texts stay a few megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession):
    """Shuffle files of queries that run in here go when those end: else they stay beside those of the next queries until the
    driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


class Table:
    """A DataFrame written once to the shared folder: it cuts lineage, and a lost executor costs nothing."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        small_batches(self.spark)
        self.path = table_path(self.spark, name)
        with _shuffles_go(self.spark):
            df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def stored(df: DataFrame, name: str) -> DataFrame:
    return Table(df, name).df


@atexit.register
def _clean() -> None:
    for spark, path in _ROOTS:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended
            return


def _stars(links: DataFrame) -> bool:
    """Whether distinct edges u < v (self-edges aside) are stars: every v has one u, and no u is a v. The centre of
    a star is then the smallest node of its component. Counts are combined before their exchange."""
    links = links.filter("u <> v")
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("n").agg(F.max("up").alias("up"), F.sum("down").alias("down"))
    return not ends.agg(F.max(F.expr("down > 1 or (down = 1 and up = 1)"))).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over undirected edges (a, b); self-edges name single nodes.

    Alternating large-star and small-star passes. Each pass groups by node with a partial minimum, and
    joins back by node; a node of very high degree is spread by the skew handling of the joins. The edge
    list never exceeds its first size by more than one row for each node, and the passes needed grow
    with the logarithm of the longest path. Every pass is written to the shared folder, and none is made
    where the edges are stars already.
    """
    base = Table(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "cc-in")
    now = base
    while not _stars(now.df):
        links = now.df.filter("u <> v")
        # large star: every larger neighbour of a node joins the smallest of the node's neighbourhood
        both = links.select(F.col("u").alias("n"), F.col("v").alias("m")).union(links.select("v", "u"))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("root"))
        up = both.filter("m > n").join(least, "n").select(F.col("root").alias("u"), F.col("m").alias("v"))
        mid = Table(up.filter("u <> v").distinct(), "cc")
        # small star: every smaller neighbour and the node itself join the smallest neighbour
        low = mid.df.groupBy("v").agg(F.min("u").alias("root"))
        moved = mid.df.join(low, "v").select(F.least("root", "u").alias("u"), F.greatest("root", "u").alias("v"))
        after = Table(moved.union(low.select("root", "v")).filter("u <> v").distinct(), "cc")
        mid.drop()
        if now is not base:
            now.drop()
        now = after
    nodes = base.df.select(F.col("u").alias("node")).union(base.df.select("v")).distinct()
    roots = now.df.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("low"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("low", "node").alias("root"))
