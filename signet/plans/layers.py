"""Graph layers as plans over long vectors (id, pos, val); weights are lists of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signet.functions import leaky
from signet.operators import edges as E
from signet.operators import laplacian as L
from signet.operators import propagate as P
from signet.operators.proximity import InOut

Matrix = list[list[float]]


def conv_base(edges: DataFrame, nodes: DataFrame, x: DataFrame, fill: float | None = 0.5) -> DataFrame:
    """D_row^-1 (A + fill I) x, gathered at the source."""
    return P.spmm(L.row_normalized(edges, nodes, fill), x, to="src")


def dgcn_conv(edges: DataFrame, nodes: DataFrame, x: DataFrame, improved: bool = False) -> DataFrame:
    """Symmetric propagation without weights; improved: loops of 2."""
    return P.spmm(L.symmetric_normalized(edges, nodes, 2.0 if improved else 1.0), x)


def in_out_conv(factors: InOut, scales: DataFrame, x: DataFrame, width: int) -> DataFrame:
    """What dgcn_conv gives on the pairs of an in- or out-proximity, with scales = factors.symmetric(nodes)."""
    names = [f"v{k}" for k in range(width)]
    wide = x.groupBy("id").agg(*[F.sum(F.when(F.col("pos") == k, F.col("val"))).alias(n) for k, n in enumerate(names)])
    wide = wide.join(scales, "id").select("id", *[(F.col("r") * F.col(n)).alias(n) for n in names])
    looped = wide.join(scales.filter("loop <> 0"), "id").select("id", *[(F.col("loop") * F.col(n)).alias(n) for n in names])
    got = factors.times(wide).unionByName(looped).join(scales, "id")
    each = F.posexplode(F.array(*[F.col("r") * F.col(n) for n in names])).alias("pos", "val")
    return got.select("id", each).filter("val is not null")


def gcn_conv(edges: DataFrame, nodes: DataFrame, x: DataFrame, weight: Matrix, bias: list[float] | None = None) -> DataFrame:
    out = P.spmm(L.symmetric_normalized(edges, nodes), P.dense(x, weight))
    return with_bias(out, bias)


def with_bias(x: DataFrame, bias: list[float] | None) -> DataFrame:
    if bias is None:
        return x
    return x.withColumn("val", F.col("val") + F.element_at(F.array(*[F.lit(float(b)) for b in bias]), F.col("pos") + 1))


def digcn_conv(adjacency: DataFrame, x: DataFrame, weight: Matrix, bias: list[float] | None = None) -> DataFrame:
    """x W over an adjacency that is normalised already."""
    return with_bias(P.spmm(adjacency, P.dense(x, weight)), bias)


def inception(x: DataFrame, first: DataFrame, second: DataFrame, weights: tuple[Matrix, Matrix, Matrix], bias: list[float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """x W0 + b, and the convolutions over both adjacencies."""
    return P.dense(x, weights[0], bias), digcn_conv(first, x, weights[1]), digcn_conv(second, x, weights[2])


def chebyshev(laplacian: DataFrame, x: DataFrame, weights: list[Matrix], bias: list[float] | None = None) -> DataFrame:
    """(id, pos, re, im): complex Chebyshev filter of x(id, pos, re, im) over L(src, dst, re, im), L rescaled.

    Both parts of the vector travel in one join, for the products with the real and the imaginary part of L: four real chains."""
    # columns: rr and ri from L's real part, ir and ii from its imaginary part
    now = x.select("id", "pos", F.col("re").alias("rr"), F.col("im").alias("ri"), F.col("re").alias("ir"), F.col("im").alias("ii"))
    names = ("rr", "ri", "ir", "ii")
    terms, before = [now], None
    for k in range(1, len(weights)):
        moved = laplacian.join(now.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "pos").agg(
            *[F.sum(F.col("re" if c[0] == "r" else "im") * F.col(c)).alias(c) for c in names])
        if k > 1:
            twice = moved.select("id", "pos", *[(2 * F.col(c)).alias(c) for c in names])
            less = before.select("id", "pos", *[(-F.col(c)).alias(c) for c in names])
            moved = twice.unionByName(less).groupBy("id", "pos").agg(*[F.sum(c).alias(c) for c in names])
        before, now = now, moved
        terms.append(now)
    parts = None
    for t, w in zip(terms, weights, strict=True):
        rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in w])
        spread = t.select("id", *names, F.posexplode(F.element_at(rows, F.col("pos") + 1)).alias("pos", "m"))
        own = spread.select("id", "pos", ((F.col("rr") - F.col("ii")) * F.col("m")).alias("re"), ((F.col("ir") + F.col("ri")) * F.col("m")).alias("im"))
        parts = own if parts is None else parts.union(own)
    out = parts.groupBy("id", "pos").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    if bias is not None:
        b = F.element_at(F.array(*[F.lit(float(v)) for v in bias]), F.col("pos") + 1)
        out = out.select("id", "pos", (F.col("re") + b).alias("re"), (F.col("im") + b).alias("im"))
    return out


def magnet_conv(edges: DataFrame, nodes: DataFrame, x: DataFrame, weights: list[Matrix], q: float = 0.25, normalization: str | None = "sym", lambda_max: float = 2.0, bias: list[float] | None = None) -> DataFrame:
    lap = L.magnetic(edges, nodes, q, normalization)
    return chebyshev(L.chebyshev_scaled(lap, nodes, lambda_max), x, weights, bias)


def ms_conv(edges: DataFrame, nodes: DataFrame, x: DataFrame, weights: list[Matrix], q: float = 0.25, normalization: str | None = "sym", lambda_max: float = 2.0, absolute_degree: bool = True, bias: list[float] | None = None) -> DataFrame:
    lap = L.magnetic(edges, nodes, q, normalization, "absolute" if absolute_degree else "net")
    return chebyshev(L.chebyshev_scaled(lap, nodes, lambda_max), x, weights, bias)


def sgcn_conv(edges: DataFrame, x: DataFrame, width: int, balanced: Matrix, unbalanced: Matrix, first: bool, normalize: bool = False) -> DataFrame:
    """Signed convolution. First: [mean of positive neighbours, own] and [mean of negative ones, own], each by its matrix.

    Later, x holds both halves: the balanced one takes positive neighbours' balanced and negative neighbours'
    unbalanced halves, the unbalanced one the opposite, each with its own half. Places without neighbours are 0."""
    pos, neg = E.positive(edges), edges.filter("w < 0")
    if first:
        halves = [(P.concat((P.aggregate(pos, x), width), (x, width)), balanced), (P.concat((P.aggregate(neg, x), width), (x, width)), unbalanced)]
    else:
        half = width // 2
        b = x.filter(F.col("pos") < half)
        u = x.filter(F.col("pos") >= half).withColumn("pos", F.col("pos") - half)
        halves = [
            (P.concat((P.aggregate(pos, b), half), (P.aggregate(neg, u), half), (b, half)), balanced),
            (P.concat((P.aggregate(pos, u), half), (P.aggregate(neg, b), half), (u, half)), unbalanced)]
    out = P.concat(*[(P.dense(v, w), len(w[0])) for v, w in halves])
    return P.l2_normalized(out) if normalize else out


def _pair_scores(h: DataFrame, alpha: list[float]) -> DataFrame:
    """(id, as_src, as_dst): a vector's share of alpha . [h_src, h_dst] at either end."""
    half = len(alpha) // 2
    a = F.array(*[F.lit(float(v)) for v in alpha])
    return h.groupBy("id").agg(F.sum(F.element_at(a, F.col("pos") + 1) * F.col("val")).alias("as_src"), F.sum(F.element_at(a, F.col("pos") + 1 + half) * F.col("val")).alias("as_dst"))


def snea_attention(parts: list[tuple[DataFrame, DataFrame]], alpha: list[float]) -> DataFrame:
    """(id, pos, val): targets' own vectors, weighted by attention over their edges.

    parts: (pairs (src, dst), vectors): scores tanh(alpha . [h_src, h_dst]) and messages h_dst use the part's vectors;
    the softmax by target runs over the edges of all parts."""
    scored = None
    for k, (pairs, h) in enumerate(parts):
        s = _pair_scores(h, alpha)
        e = pairs.join(s.select(F.col("id").alias("src"), "as_src"), "src").join(s.select(F.col("id").alias("dst"), "as_dst"), "dst")
        e = e.select("dst", F.lit(k).alias("part"), F.tanh(F.col("as_src") + F.col("as_dst")).alias("s"))
        scored = e if scored is None else scored.union(e)
    # scores lie in [-1, 1], so their exponentials need no shift, and sums by target and part are enough
    mass = scored.groupBy("dst", "part").agg(F.sum(F.exp("s")).alias("x"))
    mass = mass.withColumn("att", F.col("x") / F.sum("x").over(Window.partitionBy("dst")))
    out = None
    for k, (_, h) in enumerate(parts):
        own = mass.filter(F.col("part") == k).select(F.col("dst").alias("id"), "att").join(h, "id").select("id", "pos", (F.col("val") * F.col("att")).alias("val"))
        out = own if out is None else out.union(own)
    return out.groupBy("id", "pos").agg(F.sum("val").alias("val"))


def snea_conv(edges: DataFrame, nodes: DataFrame, x: DataFrame, width: int, w_b: Matrix, w_u: Matrix, alpha_b: list[float], alpha_u: list[float], first: bool) -> DataFrame:
    """Signed attention. First: each sign's edges with loops, by that sign's matrix and alpha. Later, x holds both
    halves; a half attends over positive edges and loops with its own vectors and over negative edges with the other's,
    both by the half's matrix. Loops reach up to the largest id of the sign's own edges."""
    pos, neg = E.without_loops(E.positive(edges)).select("src", "dst"), E.without_loops(edges.filter("w < 0")).select("src", "dst")

    def looped(e: DataFrame) -> DataFrame:
        top = e.agg(F.max(F.greatest("src", "dst")).alias("top"))
        return e.union(nodes.crossJoin(top).filter("id <= top").select(F.col("id").alias("src"), F.col("id").alias("dst")))

    if first:
        return P.concat((snea_attention([(looped(pos), P.dense(x, w_b))], alpha_b), len(w_b[0])), (snea_attention([(looped(neg), P.dense(x, w_u))], alpha_u), len(w_u[0])))
    half = width // 2
    b, u = x.filter(F.col("pos") < half), x.filter(F.col("pos") >= half).withColumn("pos", F.col("pos") - half)
    with_loops = looped(pos)
    out_b = snea_attention([(with_loops, P.dense(b, w_b)), (neg, P.dense(u, w_b))], alpha_b)
    out_u = snea_attention([(with_loops, P.dense(u, w_u)), (neg, P.dense(b, w_u))], alpha_u)
    return P.concat((out_b, len(w_b[0])), (out_u, len(w_u[0])))


def gat_conv(pairs: DataFrame, nodes: DataFrame, x: DataFrame, weight: Matrix, a_src: list[float], a_dst: list[float], bias: list[float] | None = None, slope: float = 0.2) -> DataFrame:
    """Graph attention of one head: leaky scores, softmax by target over its neighbours and itself."""
    h = P.dense(x, weight)
    vec = lambda v: F.element_at(F.array(*[F.lit(float(t)) for t in v]), F.col("pos") + 1)
    s = h.groupBy("id").agg(F.sum(vec(a_src) * F.col("val")).alias("ss"), F.sum(vec(a_dst) * F.col("val")).alias("sd"))
    e = pairs.select("src", "dst").filter("src <> dst").union(nodes.select("id", F.col("id").alias("dst"))).distinct()
    e = e.join(s.select(F.col("id").alias("src"), "ss"), "src").join(s.select(F.col("id").alias("dst"), "sd"), "dst").withColumn("s", leaky(F.col("ss") + F.col("sd"), slope))
    own = Window.partitionBy("dst")
    e = e.withColumn("x", F.exp(F.col("s") - F.max("s").over(own))).withColumn("w", F.col("x") / F.sum("x").over(own)).select("src", "dst", "w")
    return with_bias(P.spmm(e, h), bias)


def motif_attention(motifs: DataFrame, nodes: DataFrame, x: DataFrame, gats: list[tuple[Matrix, list[float], list[float]]], slope: float = 0.2) -> DataFrame:
    """gat_conv over many lists at once: motifs (motif, src, dst), one (weight, a_src, a_dst) for each; outputs side by side.

    All lists share their joins: vectors are made for each motif by literal matrices, and the softmax runs by (motif, target)."""
    m, out = len(gats), len(gats[0][0][0])
    lit = lambda v: F.array(*[lit(t) for t in v]) if isinstance(v, list | tuple) else F.lit(float(v))
    cube = lit([w for w, _, _ in gats])
    at = F.element_at(F.element_at(cube, F.col("motif") + 1), F.col("pos") + 1)
    every = x.withColumn("motif", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select("motif", "id", "val", F.posexplode(at).alias("pos", "c"))
    h = every.groupBy("motif", "id", "pos").agg(F.sum(F.col("val") * F.col("c")).alias("val"))
    side = lambda k: F.element_at(F.element_at(lit([g[k] for g in gats]), F.col("motif") + 1), F.col("pos") + 1)
    s = h.groupBy("motif", "id").agg(F.sum(side(1) * F.col("val")).alias("ss"), F.sum(side(2) * F.col("val")).alias("sd"))
    loops = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("motif"), F.col("id").alias("src"), F.col("id").alias("dst"))
    e = motifs.select("motif", "src", "dst").filter("src <> dst").union(loops).distinct()
    e = e.join(s.select("motif", F.col("id").alias("src"), "ss"), ["motif", "src"]).join(s.select("motif", F.col("id").alias("dst"), "sd"), ["motif", "dst"])
    e = e.withColumn("s", leaky(F.col("ss") + F.col("sd"), slope))
    own = Window.partitionBy("motif", "dst")
    e = e.withColumn("x", F.exp(F.col("s") - F.max("s").over(own))).withColumn("w", F.col("x") / F.sum("x").over(own))
    moved = e.select("motif", "src", "dst", "w").join(h.withColumnRenamed("id", "src"), ["motif", "src"]).groupBy("motif", "dst", "pos").agg(F.sum(F.col("w") * F.col("val")).alias("val"))
    return moved.select(F.col("dst").alias("id"), (F.col("motif") * out + F.col("pos")).cast("int").alias("pos"), "val")


def sdr_layer(motifs: DataFrame, nodes: DataFrame, x: DataFrame, width: int, gats: list[tuple], w1: Matrix, b1: list[float], w2: Matrix, b2: list[float]) -> DataFrame:
    """One attention for each motif list, side by side with x, through two dense steps with tanh between."""
    z = P.concat((x, width), (motif_attention(motifs, nodes, x, gats), len(gats) * len(gats[0][0][0])))
    return P.dense(P.activate(P.dense(z, w1, b1), "tanh"), w2, b2)


def dimpa(edges: DataFrame, nodes: DataFrame, xs: DataFrame, xt: DataFrame, width: int, hops: int = 2, w_s: list[float] | None = None, w_t: list[float] | None = None, fill: float = 0.5) -> DataFrame:
    """Weighted sums of hops over the edges for xs and over reversed edges for xt, side by side."""
    def hop_sum(e: DataFrame, x: DataFrame, w: list[float]) -> DataFrame:
        a = L.row_normalized(e, nodes, fill)
        now, parts = x, [P.scale(x, w[0])]
        for h in range(1, hops + 1):
            now = P.spmm(a, now, to="src")
            parts.append(P.scale(now, w[h]))
        return P.add(*parts)

    ones = [1.0] * (hops + 1)
    return P.concat((hop_sum(edges, xs, w_s or ones), width), (hop_sum(E.reverse(edges), xt, w_t or ones), width))


def simpa_half(pos: DataFrame, neg: DataFrame, nodes: DataFrame, xp: DataFrame, xn: DataFrame, hops: int, fill: float) -> tuple[DataFrame, DataFrame]:
    """(positive, negative) sums: positive hops only, and all paths of at most `hops` with exactly one negative hop; weights 1."""
    ap, an = L.row_normalized(pos, nodes, fill), L.row_normalized(neg, nodes, None)
    now, p = xp, [xp]
    for _ in range(hops):
        now = P.spmm(ap, now, to="src")
        p.append(now)
    terms, now = [], xn
    for before in range(hops):
        if before:
            now = P.spmm(ap, now, to="src")
        far = P.spmm(an, now, to="src")
        terms.append(far)
        for _ in range(hops - 1 - before):
            far = P.spmm(ap, far, to="src")
            terms.append(far)
    return P.add(*p), P.add(*terms)


def simpa(pos: DataFrame, neg: DataFrame, nodes: DataFrame, xs: list[DataFrame], width: int, hops: int = 2, fill: float = 0.5, directed: bool = False) -> DataFrame:
    """xs: (positive, negative) vectors, with directed also those of the target side, which use reversed edges."""
    halves = list(simpa_half(pos, neg, nodes, xs[0], xs[1], hops, fill))
    if directed:
        halves += simpa_half(E.reverse(pos), E.reverse(neg), nodes, xs[2], xs[3], hops, fill)
    return P.concat(*[(h, width) for h in halves])
