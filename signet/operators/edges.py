"""Edge tables: parts by sign, loops, symmetry, lookups and subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coalesce(edges: DataFrame) -> DataFrame:
    """Weights of equal edges added; edges that cancel out stay, with weight 0."""
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def reverse(edges: DataFrame) -> DataFrame:
    others = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others)


def positive(edges: DataFrame) -> DataFrame:
    return edges.filter("w > 0")


def negative(edges: DataFrame) -> DataFrame:
    """Edges below 0 with their weight negated."""
    return edges.filter("w < 0").withColumn("w", -F.col("w"))


def sign_partition(edges: DataFrame) -> DataFrame:
    return edges.filter("w <> 0").select("src", "dst", F.abs("w").alias("w"), F.when(F.col("w") > 0, "p").otherwise("n").alias("part"))


def unweighted(edges: DataFrame, signed: bool) -> DataFrame:
    return edges.withColumn("w", F.signum("w") if signed else F.lit(1.0))


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def add_loops(edges: DataFrame, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
    """One more loop for every node, also where it has one."""
    return edges.select("src", "dst", "w").unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(fill).alias("w")))


def add_remaining_loops(edges: DataFrame, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
    """A loop for each node that has none; others keep their weight."""
    held = edges.filter("src = dst").select(F.col("src").alias("id"))
    missing = nodes.select("id").join(held, "id", "left_anti")
    return edges.select("src", "dst", "w").unionByName(missing.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(fill).alias("w")))


def to_undirected(edges: DataFrame) -> DataFrame:
    """Pairs in both directions, each once."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def predicates(edges: DataFrame) -> DataFrame:
    """One row: is_signed, is_directed (differs from its transpose), is_weighted (unsigned) and is_weighted_signed."""
    r = reverse(edges).select("src", "dst", F.col("w").alias("r"))
    off = edges.join(r, ["src", "dst"], "full_outer").filter(~F.col("w").eqNullSafe(F.col("r"))).agg(F.count("*").alias("off"))
    pos, neg = F.when(F.col("w") > 0, F.col("w")), F.when(F.col("w") < 0, F.col("w"))
    one = edges.agg(F.min("w").alias("lo"), F.max("w").alias("hi"), F.min(pos).alias("pl"), F.max(pos).alias("ph"), F.min(neg).alias("nl"), F.max(neg).alias("nh"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return one.crossJoin(off).select(
        yes(F.col("lo") * F.col("hi") < 0).alias("is_signed"), (F.col("off") > 0).alias("is_directed"),
        yes(F.col("lo") != F.col("hi")).alias("is_weighted"), (yes(F.col("pl") != F.col("ph")) | yes(F.col("nl") != F.col("nh"))).alias("is_weighted_signed"))


def summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    one = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("w") > 0).alias("n_pos"), F.count_if(F.col("w") < 0).alias("n_neg"))
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(one).crossJoin(predicates(edges))


def probe(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds w (of the edge src to dst) and w_rev (dst to src) to pairs; 0 where there is none."""
    fwd = edges.select("src", "dst", F.col("w"))
    rev = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("w_rev"))
    zero = F.lit(0.0)
    return pairs.join(fwd, ["src", "dst"], "left").join(rev, ["src", "dst"], "left").withColumns({"w": F.coalesce("w", zero), "w_rev": F.coalesce("w_rev", zero)})


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges between kept nodes, ids as they were."""
    ids = keep.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "w")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, row_sum, col_sum): sums of absolute weights of the edges that leave and that reach a node.

    In this order, the two are what the literature's code calls in- and out-degree."""
    both = edges.select(F.col("src").alias("id"), F.abs("w").alias("r"), F.lit(0.0).alias("c")).union(edges.select("dst", F.lit(0.0), F.abs("w")))
    return _filled(nodes, both.groupBy("id").agg(F.sum("r").alias("row_sum"), F.sum("c").alias("col_sum")), ("row_sum", "col_sum"))


def signed_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, row_pos, row_neg, col_pos, col_neg); equal edges are added first."""
    e = coalesce(edges)
    p, n, z = F.greatest("w", F.lit(0.0)), F.greatest(-F.col("w"), F.lit(0.0)), F.lit(0.0)
    both = e.select(F.col("src").alias("id"), p.alias("a"), n.alias("b"), z.alias("c"), z.alias("d")).union(e.select("dst", z, z, p, n))
    names = ("row_pos", "row_neg", "col_pos", "col_neg")
    return _filled(nodes, both.groupBy("id").agg(*[F.sum(k).alias(v) for k, v in zip("abcd", names, strict=True)]), names)


def _filled(nodes: DataFrame, sums: DataFrame, names) -> DataFrame:
    return nodes.select("id").join(sums, "id", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


def sparsify(entries: DataFrame, n: int, level: float) -> DataFrame:
    """Entries of an n x n matrix whose absolute value reaches that of the int(n*n*level)-th largest; ties stay.

    All n*n places count, the empty ones as 0. ValueError where level is not in (0, 1] or keeps nothing."""
    k = int(n * n * level)
    if not 0 < level <= 1 or k < 1:
        raise ValueError("level must be in (0, 1] and keep at least one entry")
    # entries are counted by value: few rows even where the matrix is large
    from pyspark.sql import Window

    by = entries.select(F.abs("w").alias("a")).groupBy("a").agg(F.count("*").alias("m"))
    upto = by.withColumn("upto", F.sum("m").over(Window.orderBy(F.desc("a"))))
    least = upto.filter(F.col("upto") >= k).agg(F.max("a").alias("least"))
    return entries.crossJoin(least).filter((F.abs("w") >= F.coalesce("least", F.lit(0.0))) & (F.col("w") != 0)).drop("least")
