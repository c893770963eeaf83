"""Second-order proximities and personalised PageRank adjacencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signet.functions import inverse, inverse_root

from . import blocks as B
from . import edges as E
from .iterate import kept
from .laplacian import row_degree_symmetric, row_normalized


def second_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(P^T P + P P^T) / 2 on the support that both have, then scaled by row degrees; P is row-stochastic with loops.

    The products are taken twice for pairs of blocks of nodes, first for the degrees, so that no row is written for a pair."""
    p = kept(row_normalized(E.coalesce(E.add_loops(edges, nodes, 1.0)), nodes, None))
    size = p.agg(F.count("*").alias("n"), F.approx_count_distinct("src").alias("s"), F.approx_count_distinct("dst").alias("d")).first()
    ends = F.array(*[F.struct(F.col(a).alias("node"), F.col(b).alias("nbr"), F.lit(a == "src").alias("out"), F.col("w")) for a, b in (("src", "dst"), ("dst", "src"))])
    block = B.dealt(p.filter("src is not null and dst is not null").select(F.inline(ends)), F.col("node"), 2 * size.n, max(size.s, size.d), B.pack_weights, B.WEIGHTS)
    root = kept(B.pass_by(block, B.second_order(False), "block int, r binary"))  # 8 bytes a node
    return B.pass_by(block.join(F.broadcast(root), "block"), B.second_order(True), "src long, dst long, w double")


def in_out_proximity(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst, w): sum over k of a[k,i] a[k,j] / colsum[k] (`in`), or of a[i,k] a[j,k] / rowsum[k] (`out`), sums of 0 as 1.

    The sums are those of node k itself, by column for `in` and by row for `out`."""
    a = E.coalesce(edges)
    end = "dst" if direction == "in" else "src"
    d = a.groupBy(F.col(end).alias("k")).agg(F.sum("w").alias("d")).select("k", F.when(F.col("d") == 0, 1.0).otherwise(F.col("d")).alias("d"))
    shared, other = ("src", "dst") if direction == "in" else ("dst", "src")
    x = a.select(F.col(shared).alias("k"), F.col(other).alias("src"), F.col("w").alias("x"))
    y = a.select(F.col(shared).alias("k"), F.col(other).alias("dst"), F.col("w").alias("y"))
    scaled = y.join(d, "k", "left").withColumn("y", F.col("y") / F.coalesce("d", F.lit(1.0))).drop("d")
    return x.join(scaled, "k").groupBy("src", "dst").agg(F.sum(F.col("x") * F.col("y")).alias("w"))


class InOut:
    """The adjacency of in_out_proximity by its factors: sum over k of a[k,i] a[k,j] / d[k] (`in`) as a pass from j to k and one
    from k to i. Rows are edges, never pairs of edges that share an endpoint, of which a node has its degree squared."""

    def __init__(self, edges: DataFrame, direction: str):
        a = E.coalesce(edges)
        end, shared, other = ("dst", "src", "dst") if direction == "in" else ("src", "dst", "src")
        d = a.groupBy(F.col(end).alias("k")).agg(F.sum("w").alias("d")).select("k", F.when(F.col("d") == 0, 1.0).otherwise(F.col("d")).alias("_d"))
        self.a, self.d = a.select(F.col(shared).alias("k"), F.col(other).alias("id"), F.col("w").alias("_x")), d

    def times(self, wide: DataFrame) -> DataFrame:
        """The adjacency times wide(id, one column for each position)."""
        names = [c for c in wide.columns if c != "id"]
        through = self.a.join(wide, "id").groupBy("k").agg(*[F.sum(F.col("_x") * F.col(c)).alias(c) for c in names])
        through = through.join(self.d, "k", "left").select("k", *[(F.col(c) / F.coalesce("_d", F.lit(1.0))).alias(c) for c in names])
        return self.a.join(through, "k").groupBy("id").agg(*[F.sum(F.col("_x") * F.col(c)).alias(c) for c in names])

    def symmetric(self, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
        """(id, r, loop): degrees by column with remaining loops of weight fill, to the power -1/2, and the loops: a node with an edge
        to share has a place on the diagonal, others get one."""
        ones = nodes.select("id", F.lit(1.0).alias("d"))
        d = ones.select("id").join(self.times(ones), "id", "left")
        return d.select("id", inverse_root(F.coalesce("d", F.lit(fill))).alias("r"), F.when(F.col("d").isNull(), fill).otherwise(0.0).alias("loop"))


def pagerank(edges: DataFrame, nodes: DataFrame, alpha: float = 0.1, iterations: int = 100, tol: float | None = 1e-6) -> DataFrame:
    """(id, val): stationary vector of the walk with restarts, by power iteration, adding up to 1.

    With tol None exactly `iterations` steps are made; else it stops when a step moves the vector by tol or less.
    """
    d = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    n = nodes.count()
    base = kept(nodes.select("id").join(d, "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d")))
    walk = kept(edges.join(base.select(F.col("id").alias("src"), "d"), "src").select("src", "dst", ((1 - alpha) * F.col("w") * inverse(F.col("d"))).alias("w")))
    z = F.when(F.col("d") != 0, alpha * (1 + alpha)).otherwise((1 - alpha) / (1 + alpha) + alpha * (1 + alpha))
    x = base.select("id", F.lit(1.0 / n).alias("val"))
    for k in range(iterations):
        moved = walk.join(x.select(F.col("id").alias("src"), "val"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("val")).alias("m"))
        back = x.join(base, "id").agg(F.sum(z * F.col("val")).alias("b"))
        new = base.join(moved, "id", "left").crossJoin(back).select("id", (F.coalesce("m", F.lit(0.0)) + F.col("b") / ((1 + alpha) * n)).alias("val"))
        if tol is not None or k % 5 == 4:
            new = kept(new)
        if tol is not None:
            step = new.join(x.withColumnRenamed("val", "old"), "id").agg(F.sqrt(F.sum((F.col("val") - F.col("old")) * (F.col("val") - F.col("old"))))).first()[0]
            x = new
            if step is not None and step <= tol:
                break
        x = new
    total = x.agg(F.sum("val").alias("total"))
    return x.crossJoin(total).select("id", (F.col("val") / F.col("total")).alias("val"))


def pagerank_laplacian(edges: DataFrame, nodes: DataFrame, x: DataFrame) -> DataFrame:
    """Half of Pi^1/2 P Pi^-1/2 and its transpose, places of no value as 0."""
    p = row_normalized(edges, nodes, None)
    v = x.select("id", F.sqrt("val").alias("r"))
    s = p.join(v.select(F.col("id").alias("src"), F.col("r").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("r").alias("b")), "dst")
    s = s.select("src", "dst", (F.col("a") * F.col("w") * inverse(F.col("b")) / 2).alias("w"))
    return s.union(s.select("dst", "src", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def fast_appr(edges: DataFrame, nodes: DataFrame, alpha: float = 0.1, iterations: int = 100, tol: float | None = 1e-6) -> DataFrame:
    a = E.coalesce(E.add_loops(edges, nodes, 1.0))
    return row_degree_symmetric(pagerank_laplacian(a, nodes, pagerank(a, nodes, alpha, iterations, tol)))


def appr_stationary(edges: DataFrame, nodes: DataFrame, alpha: float = 0.1, iterations: int = 60) -> DataFrame:
    """(id, val) of the walk that leaves to a teleport node with alpha and comes back evenly, without that node, summing to 1."""
    a = E.coalesce(E.add_loops(edges, nodes, 1.0))
    n = nodes.count()
    p = kept(row_normalized(a, nodes, None).withColumn("w", F.col("w") * (1 - alpha)))
    x = nodes.select("id", F.lit(1.0 / n).alias("val"))
    for k in range(iterations):
        moved = p.join(x.select(F.col("id").alias("src"), "val"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("val")).alias("m"))
        # every node gives alpha of its mass to the teleport node, which hands it back in equal parts
        mass = x.agg(F.sum("val").alias("mass"))
        x = nodes.select("id").join(moved, "id", "left").crossJoin(mass).select("id", (F.coalesce("m", F.lit(0.0)) + F.col("mass") * (alpha / n)).alias("val"))
        if k % 5 == 4:
            x = kept(x)
    total = x.agg(F.sum("val").alias("total"))
    return x.crossJoin(total).select("id", (F.col("val") / F.col("total")).alias("val"))


def appr_directed(edges: DataFrame, nodes: DataFrame, alpha: float = 0.1, iterations: int = 60) -> DataFrame:
    a = E.coalesce(E.add_loops(edges, nodes, 1.0))
    return row_degree_symmetric(pagerank_laplacian(a, nodes, appr_stationary(edges, nodes, alpha, iterations)))
