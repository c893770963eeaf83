"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A source of weight w and S words may take at most EPOCHS * S words. The level L at which the sum of
min(L * w, cap) is the wanted total is found from a window over the sources in the order of cap / w:
sources below the level are clamped, the rest share what is left by weight. That is the fixed point of
clamping and resharing until no source is above its cap.

With target T of a source, every document is taken floor(T / S) times, and the rest R = T - floor(T/S) * S
goes to documents in a seeded order until it is used up; the last one gives the words that are missing. The
running sum that this needs is kept in two levels, so a source with any share of the rows is spread: sums
for hash buckets of a source, then a window inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCHS, SEED = 3, 0
#: Weights repeat in this order over the sources by code point, a null source last.
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of WORD matches; null: 0. Words are the starts of runs, counted on the trimmed text's gaps."""
    flat = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WORD, "w")
    return F.length(F.translate(flat, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sources: DataFrame, weight: Column, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) -> adds `target`; the targets sum to the sum of all sizes.

    A source of no words gets 0. One row for each source passes the window's single task."""
    s = sources.withColumn("__w", weight.cast("double")).withColumn("__cap", F.col("source_size").cast("double") * epochs)
    ratio = Window.orderBy(F.col("__cap") / F.col("__w"), "source")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    zero = F.lit(0.0)
    s = s.withColumn("__level", (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("__cap").over(before), zero)) / F.sum("__w").over(after))
    fits = F.col("__level") * F.col("__w") <= F.col("__cap")
    s = s.withColumn("__level", F.min(F.when(fits, F.struct(F.col("__cap") / F.col("__w"), F.col("__level").alias("v")))).over(whole)["v"])
    # without a level nothing is free: every source stands at its cap
    return s.withColumn("target", F.least(F.coalesce(F.col("__level") * F.col("__w"), F.col("__cap")), F.col("__cap"))).drop("__w", "__cap", "__level")


def mix(df: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of df, then size, source_size, target, taken (words) and copies (whole documents).

    A null source is a source of its own, last in the order of weights; null and empty texts have size 0 and
    are never taken. Equal rows take adjacent places in the order. copies rounds the fraction of the one
    document in a source that is taken in part. An empty table stays empty; columns of df named like an
    added one are replaced.
    """
    added = ("size", "source_size", "target", "taken", "copies")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.lit(":"), F.md5(text)))
    base = df.withColumns({"size": n_words(F.col(f"`{text_col}`")), "__src": F.col(f"`{source_col}`"), "__key": key}).withColumn("__b", F.substring("__key", 1, 3))
    # one row for each source and bucket: the only thing that is summed before the documents are placed
    sums = base.groupBy("__src", "__b").agg(F.sum("size").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    total = sums.groupBy(F.col("__src").alias("source")).agg(F.sum("n").alias("source_size"))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    aim = targets(total.withColumn("__c", cycle), F.col("__c"), epochs).drop("__c")
    upto = Window.partitionBy("__src").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.withColumn("__before", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(
        aim, F.col("__src").eqNullSafe(F.col("source"))).select(F.col("__src").alias("s"), F.col("__b").alias("b"), "__before", "source_size", "target")
    # a source's rows meet in as many tasks as it has buckets
    placed = base.drop("source_size", "target").join(places, F.col("__src").eqNullSafe(F.col("s")) & (F.col("__b") == F.col("b")))
    inside = Window.partitionBy("s", "b").orderBy("__key", F.col(f"`{id_col}`"), "size").rowsBetween(Window.unboundedPreceding, -1)
    run = F.col("__before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target")).cast("long") - F.col("__whole") * F.col("source_size")
    placed = placed.withColumns({"__run": run, "__whole": whole}).withColumn("__extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("__run"))))
    return placed.withColumns({
        "taken": F.col("__whole") * F.col("size") + F.col("__extra"),
        "copies": (F.when(F.col("size") > 0, F.col("__whole")).otherwise(0) + F.when((F.col("__extra") > 0) & (F.col("__extra") * 2 >= F.col("size")), 1).otherwise(0)).cast("int"),
    }).select(*[F.col(f"`{c}`") for c in df.columns if c not in added], *added)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op2_sql() -> str:
    """Independent SQL: clamping and resharing repeated a fixed number of times, one running sum a source."""
    rounds = 40
    steps = ["""r0 as (select source, source_size, w, cap, false as done, (select sum(source_size) from w)::double * w / (select sum(w) from w) as target from w)"""]
    for k in range(1, rounds + 1):
        steps.append(f"""m{k} as (select *, done or target > cap as f2 from r{k - 1}),
f{k} as materialized (select (select sum(source_size) from w)::double - coalesce((select sum(cap) from m{k} where f2), 0) as rest, (select sum(w) from m{k} where not f2) as ws),
r{k} as materialized (select source, source_size, w, cap, f2 as done, case when f2 then cap else rest * w / ws end as target from m{k}, f{k})""")
    return f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
             md5('{SEED}:' || coalesce(doc_id::varchar, '-') || ':' || md5(coalesce(text, ''))) as k from documents),
t as (select source, sum(size)::bigint as source_size from d group by source),
w as materialized (select *, (((row_number() over (order by source nulls last)) - 1) % {len(WEIGHTS)} + 1)::double as w, {EPOCHS} * source_size::double as cap from t),
{', '.join(steps)},
p as (select d.doc_id, d.size, r.source_size, r.target, coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as run,
        case when r.source_size > 0 then floor(r.target / r.source_size) else 0 end::bigint as whole
      from d join r{rounds} r on d.source is not distinct from r.source)
select doc_id, size, source_size, round(target, 3) as target,
  whole * size + greatest(0, least(size, round(target)::bigint - whole * source_size - run)) as taken from p
"""
