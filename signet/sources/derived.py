"""Graphs derived from the star-schema tables. Weights are whole numbers, so sums are exact in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_graph(spark: SparkSession, sf_dir: str, loops: bool = False) -> DataFrame:
    """edges(src, dst, w): a user's event is followed by the next user's; errors count -1, other events +1.

    The next event overall is found without one global window: inside the hours, and for the last event of an
    hour from the first event of the next hour that has any (one row for each hour)."""
    ev = read(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type").withColumn("hour", F.date_trunc("hour", "ts"))
    inside = Window.partitionBy("hour").orderBy("ts", "event_id")
    ev = ev.withColumn("next", F.lead("user_id").over(inside))
    first = ev.groupBy("hour").agg(F.min(F.struct("ts", "event_id", "user_id"))["user_id"].alias("first"))
    first = first.select("hour", F.lead("first").over(Window.orderBy("hour")).alias("after"))
    ev = ev.join(F.broadcast(first), "hour")  # one row an hour of the events' span
    steps = ev.select(F.col("user_id").alias("src"), F.coalesce("next", "after").alias("dst"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("s")).filter("dst is not null")
    return _summed(steps, loops)


def supply_graph(spark: SparkSession, sf_dir: str, loops: bool = False) -> DataFrame:
    """edges(src, dst, w): suppliers of consecutive items of an order; returned items count -1."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_extendedprice")
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_extendedprice")
    steps = items.select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(order).alias("dst"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("s")).filter("dst is not null")
    return _summed(steps, loops)


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(src, dst, w): items sold from supplier nations (dst) to customer nations (src), unsigned, with loops."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
    joined = items.join(orders, "l_orderkey").join(customers, "c_custkey").join(suppliers, "l_suppkey")
    return joined.groupBy("src", "dst").agg(F.sum("n").cast("double").alias("w"))


def _summed(steps: DataFrame, loops: bool) -> DataFrame:
    edges = steps.groupBy("src", "dst").agg(F.sum("s").cast("double").alias("w")).filter("w <> 0")
    return edges if loops else edges.filter("src <> dst")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def vectors(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    """(id, pos, val) of the embeddings, in long form."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "val"))
    return e if dims is None else e.filter(F.col("pos") < dims)


#: The same graphs in SQL, for the checks.
SQL = {
    "g_ev": """select src, dst, cast(sum(s) as double) as w from (
      select user_id as src, lead(user_id) over (order by ts, event_id) as dst, case when event_type = 'error' then -1 else 1 end as s from events)
      where dst is not null and src <> dst group by src, dst having sum(s) <> 0""",
    "g_supp": """select src, dst, cast(sum(s) as double) as w from (
      select l_suppkey as src, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_returnflag, l_extendedprice) as dst,
        case when l_returnflag = 'R' then -1 else 1 end as s from lineitem)
      where dst is not null and src <> dst group by src, dst having sum(s) <> 0""",
    "g_trade": """select cast(c_nationkey as bigint) as src, cast(s_nationkey as bigint) as dst, cast(count(*) as double) as w
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
      group by c_nationkey, s_nationkey""",
    "nodes": "select src as id from g union select dst from g",
}
