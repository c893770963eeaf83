"""Magnetic and signed Laplacians and the normalisations of message passing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signet.functions import inverse, inverse_root, sqrt_inverse_diagonal

from . import edges as E


def _by_endpoints(e: DataFrame, d: DataFrame, name: str = "d") -> DataFrame:
    """Edges with the degrees of both endpoints as d_src and d_dst."""
    return e.join(d.select(F.col("id").alias("src"), F.col(name).alias("d_src")), "src").join(d.select(F.col("id").alias("dst"), F.col(name).alias("d_dst")), "dst")


def magnetic(edges: DataFrame, nodes: DataFrame, q: float = 0.25, normalization: str | None = "sym", degree: str = "plain") -> DataFrame:
    """(src, dst, re, im) of the magnetic Laplacian.

    degree: `plain` sums the symmetrised weights (unsigned graphs), `absolute` the halves of absolute weights
    in both directions, `net` the absolute values of the symmetrised weights. Entries that cancel stay as zeros.
    """
    e = E.without_loops(edges)
    both = e.select("src", "dst", "w", F.col("w").alias("t"), F.abs("w").alias("b")).union(e.select("dst", "src", "w", -F.col("w"), F.abs("w")))
    a = both.groupBy("src", "dst").agg((F.sum("w") / 2).alias("a"), F.sum("t").alias("t"), (F.sum("b") / 2).alias("b"))
    size = {"plain": F.sum("a"), "absolute": F.sum("b"), "net": F.sum(F.abs("a"))}[degree]
    d = nodes.select("id").join(a.groupBy(F.col("src").alias("id")).agg(size.alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d"))
    angle = F.lit(2 * math.pi * q) * F.col("t")
    if normalization == "sym":
        scaled = _by_endpoints(a, d).withColumn("s", -inverse_root(F.col("d_src")) * F.col("a") * inverse_root(F.col("d_dst")))
        loops = d.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    elif normalization is None:
        scaled = a.withColumn("s", -F.col("a"))
        loops = d.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("d").alias("re"), F.lit(0.0).alias("im"))
    else:
        raise ValueError("normalization must be 'sym' or None")
    return scaled.select("src", "dst", (F.col("s") * F.cos(angle)).alias("re"), (F.col("s") * F.sin(angle)).alias("im")).unionByName(loops)


def chebyshev_scaled(laplacian: DataFrame, nodes: DataFrame, lambda_max: float = 2.0) -> DataFrame:
    """2 L / lambda_max - I: loops of -1 are rows of their own beside those of L."""
    s = 0.0 if lambda_max == 0 else 2.0 / lambda_max
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(-1.0).alias("re"), F.lit(0.0).alias("im"))
    return laplacian.select("src", "dst", (F.col("re") * s).alias("re"), (F.col("im") * s).alias("im")).unionByName(loops)


def row_normalized(edges: DataFrame, nodes: DataFrame, fill: float = 0.5) -> DataFrame:
    """D^-1 A with remaining loops of weight fill (none added for fill None)."""
    a = edges if fill is None else E.add_remaining_loops(edges, nodes, fill)
    d = a.groupBy("src").agg(F.sum("w").alias("d"))
    return a.join(d, "src").select("src", "dst", (inverse(F.col("d")) * F.col("w")).alias("w"))


def symmetric_normalized(edges: DataFrame, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
    """D^-1/2 (A + fill I) D^-1/2 with degrees by column; fill 2 is the improved variant."""
    a = E.add_remaining_loops(edges, nodes, fill)
    d = a.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("d"))
    d = nodes.select("id").join(d, "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d"))
    return _by_endpoints(a, d).select("src", "dst", (inverse_root(F.col("d_src")) * F.col("w") * inverse_root(F.col("d_dst"))).alias("w"))


def row_degree_symmetric(edges: DataFrame) -> DataFrame:
    """Weights scaled on both sides by the row degree to the power -1/2."""
    d = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    left = edges.join(d.select(F.col("id").alias("src"), F.col("d").alias("d_src")), "src")
    both = left.join(d.select(F.col("id").alias("dst"), F.col("d").alias("d_dst")), "dst", "left")
    return both.select("src", "dst", (inverse_root(F.col("d_src")) * F.col("w") * F.coalesce(inverse_root(F.col("d_dst")), F.lit(0.0))).alias("w"))


def balance(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """D_p - (A_p - A_n), with D_p the row sums of the positive part: equal places are added."""
    loops = E.positive(edges).select("src", F.col("src").alias("dst"), "w")
    return loops.unionByName(edges.select("src", "dst", (-F.col("w")).alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def signed_laplacian(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """I - D^-1/2 A D^-1/2 with D the column sums of absolute weights."""
    d = E.degrees(edges, nodes).select("id", sqrt_inverse_diagonal(F.col("col_sum")).alias("d"))
    off = _by_endpoints(edges, d).select("src", "dst", (-F.col("d_src") * F.col("w") * F.col("d_dst")).alias("w"))
    return off.unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def hermitian_row_normalized(edges: DataFrame) -> DataFrame:
    """Imaginary parts of i (A - A^T), over the row's sum of absolute values: (src, dst, im)."""
    both = edges.select("src", "dst", "w").union(edges.select("dst", "src", -F.col("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w")).filter("w <> 0")
    d = both.groupBy("src").agg(F.sum(F.abs("w")).alias("d"))
    return both.join(d, "src").select("src", "dst", (F.col("w") / F.col("d")).alias("im"))


def spectral_signs(edges: DataFrame) -> DataFrame:
    """Symmetrised signs: 2 for each positive occurrence of a pair, then less 1."""
    v = edges.select("src", "dst", F.when(F.col("w") > 0, 2.0).otherwise(0.0).alias("w"))
    return v.union(v.select("dst", "src", "w")).groupBy("src", "dst").agg((F.sum("w") - 1).alias("w"))


def regularized_matvec(edges: DataFrame, nodes: DataFrame, x: DataFrame, normalization: str | None = None, tau_p: float | None = None, tau_n: float | None = None) -> DataFrame:
    """(id, val): the regularised adjacency operator of spectral features on a vector x(id, val).

    None: A x + (tau_p - tau_n) sum(x); sym: D^-1/2 of that around D^-1/2 x with the taus in D; sym_sep: each sign
    with its own degrees. The defaults of the taus are a quarter of the mean degree over the number of nodes.
    """
    if normalization not in (None, "sym", "sym_sep"):
        raise NameError("normalization must be None, 'sym' or 'sym_sep'")
    d = E.signed_degrees(edges, nodes).select("id", F.col("col_pos").alias("p"), F.col("col_neg").alias("n"))
    one = d.agg(F.count("*").cast("double").alias("size"), F.avg(F.col("p") + F.col("n")).alias("mean"))
    tau = F.lit(0.25) * F.col("mean") / F.col("size")
    one = one.withColumns({"tp": F.lit(float(tau_p)) if tau_p is not None else tau, "tn": F.lit(float(tau_n)) if tau_n is not None else tau})
    def scale(c):
        return F.lit(1.0) / F.sqrt(c)

    if normalization is None:
        parts = [(edges, F.lit(1.0), F.col("tp") - F.col("tn"))]
    elif normalization == "sym":
        parts = [(edges, scale(F.col("p") + F.col("n") + F.col("size") * (F.col("tp") + F.col("tn"))), F.col("tp") - F.col("tn"))]
    else:
        parts = [(E.positive(edges), scale(F.col("p") + F.col("size") * F.col("tp")), F.col("tp")), (edges.filter("w < 0"), scale(F.col("n") + F.col("size") * F.col("tn")), -F.col("tn"))]
    total = None
    for a, s, shift in parts:
        y = d.crossJoin(one).withColumns({"s": s, "shift": shift}).select("id", "s", "shift").join(x, "id").withColumn("y", F.col("s") * F.col("val"))
        moved = a.join(y.select(F.col("id").alias("dst"), "y"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("y")).alias("ay"))
        mean = y.agg(F.sum("y").alias("sum_y"))
        part = y.join(moved, "id", "left").crossJoin(mean).select("id", (F.col("s") * (F.coalesce("ay", F.lit(0.0)) + F.col("shift") * F.col("sum_y"))).alias("val"))
        total = part if total is None else total.unionByName(part)
    return total.groupBy("id").agg(F.sum("val").alias("val"))
