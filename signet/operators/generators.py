"""Synthetic graphs: meta-graphs and stochastic block models with hash-based random numbers.

A pair (i, j) carries an edge where its own uniform number is below the blocks' probability. The pairs of a row
are made by exploding a range for each node, which spreads over all executors; what is kept is proportional
to the edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signet.functions import exponential, hash_key, uniform

from . import edges as E


def block_sizes(n: int, k: int, ratio: float = 1) -> list[int]:
    """Sizes that add up to n: nearly even for ratio 1, else growing by a constant factor up to `ratio` in all."""
    if ratio <= 1 or k == 1:
        return [(i + 1) * n // k - i * n // k for i in range(k)]
    step = ratio ** (1 / (k - 1))
    first = n * (1 - step) / (1 - step**k)
    sizes = [int(first * step**i) for i in range(k - 1)]
    return [*sizes, n - sum(sizes)]


def meta_graph(style: str = "cyclic", k: int = 4, eta: float = 0.05, ambient: bool = False, fill: float = 0.5, seed: int = 0) -> list[list[float]]:
    """K x K orientation probabilities between blocks: 1 - eta one way, eta back, 0.5 inside, `fill` where a style has no arc.

    path: i to i+1; cyclic: also the last to the first; complete: each pair, oriented by hash; star: odd blocks away
    from the middle one, even ones towards it (the middle block itself as even or odd); multipartite: three layers of
    ceil(K/9), ceil(K/3) and the rest, each pointing back to the one before. Ambient nodes are the last block, all
    `fill`; cycles and layers leave them out of the count."""
    import hashlib

    least = {"star": 3, "multipartite": 3}.get(style, 1) + (style in ("star", "multipartite") and ambient)
    if style not in ("path", "cyclic", "complete", "star", "multipartite"):
        raise ValueError(f"unknown style {style}")
    if k < least:
        raise ValueError(f"{style} needs {least} blocks")
    m = k - 1 if ambient else k
    arcs: set[tuple[int, int]] = set()
    if style == "path":
        arcs = {(i, i + 1) for i in range(k - 1)}
    elif style == "cyclic":
        arcs = {(i, (i + 1) % m) for i in range(m)} if k > 2 else {(0, 1)} - ({(0, 1)} if ambient else set())
    elif style == "complete":
        for i in range(k):
            for j in range(i + 1, k):
                forward = k <= 2 or int(hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:8], 16) % 2 == 1
                arcs.add((i, j) if forward else (j, i))
    elif style == "star":
        middle = (k - 1) // 2
        arcs = {(middle, i) if i % 2 else (i, middle) for i in range(k) if i != middle}
    else:
        first = math.ceil(m / 9)
        second = first + math.ceil(m * 3 / 9)
        layer = [(i >= first) + (i >= second) for i in range(k)]
        arcs = {(i, j) for i in range(k) for j in range(k) if layer[i] == layer[j] + 1}
    f = [[0.5 if i == j else fill for j in range(k)] for i in range(k)]
    for i, j in arcs:
        f[i][j], f[j][i] = 1 - eta, eta
    if style == "star":
        f[middle][middle] = eta if middle % 2 else 1 - eta
    if ambient:
        for i in range(k):
            f[i][k - 1] = f[k - 1][i] = fill
    return f


def assigned(spark: SparkSession, n: int, k: int, ratio: float = 1, seed: int = 0) -> DataFrame:
    """nodes (id, y): blocks of the given sizes over a random order of the ids."""
    cuts, at = [], 0
    for size in block_sizes(n, k, ratio):
        at += size
        cuts.append(at)
    rank = F.row_number().over(Window.orderBy(hash_key(seed, "node", F.col("id")), "id")) - 1
    y = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("r") >= c))
    return spark.range(n).withColumn("r", rank).select("id", F.least(y, F.lit(k - 1)).cast("int").alias("y"))


def pairs_below(nodes: DataFrame, probability: list[list[float]], seed, n: int, upper: bool = False) -> DataFrame:
    """(src, dst, k, l): ordered pairs (or those with src < dst) whose uniform number is below the blocks' probability."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in probability])
    first = F.col("src") + 1 if upper else F.lit(0).cast("long")
    source = nodes.select(F.col("id").alias("src"), F.col("y").alias("k"))
    spread = source.filter(first <= n - 1).withColumn("dst", F.explode(F.sequence(first, F.lit(n - 1).cast("long")))) if upper else source.withColumn("dst", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    # chances against the largest probability drop most pairs before the other block is looked up
    most = max((v for row in probability for v in row), default=0.0)
    drawn = spread.withColumn("u", uniform(seed, F.col("src"), F.col("dst"))).filter((F.col("u") < most) & (F.col("src") != F.col("dst")))
    blocks = nodes.select(F.col("id").alias("dst"), F.col("y").alias("l"))
    return drawn.join(blocks, "dst").filter(F.col("u") < F.element_at(F.element_at(table, F.col("k") + 1), F.col("l") + 1)).select("src", "dst", "k", "l")


def dsbm(spark: SparkSession, n: int, k: int, p: float, f: list[list[float]], ratio: float = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a directed block model with chances p F[k][l]."""
    nodes = assigned(spark, n, k, ratio, seed)
    found = pairs_below(nodes, [[p * v for v in row] for row in f], seed, n)
    return found.select("src", "dst", F.lit(1.0).alias("w")), nodes


def sdsbm(spark: SparkSession, n: int, k: int, p: float, f: list[list[float]], ratio: float = 1, eta: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a signed directed block model: chances p |F|, signs of F, and exactly int(eta * edges) signs flipped."""
    nodes = assigned(spark, n, k, ratio, seed)
    found = pairs_below(nodes, [[p * abs(v) for v in row] for row in f], seed, n)
    negative = F.array(*[F.array(*[F.lit(v < 0) for v in row]) for row in f])
    sign = F.when(F.element_at(F.element_at(negative, F.col("k") + 1), F.col("l") + 1), -1.0).otherwise(1.0)
    signed = found.select("src", "dst", sign.alias("w"), hash_key(seed, "flip", F.col("src"), F.col("dst")).alias("h"))
    rank = F.row_number().over(Window.orderBy("h", "src", "dst"))
    total = signed.agg(F.count("*").alias("m"))
    flipped = signed.withColumn("r", rank).crossJoin(total)
    return flipped.select("src", "dst", F.when(F.col("r") <= F.floor(F.col("m") * eta), -F.col("w")).otherwise(F.col("w")).alias("w")), nodes


def weight(kind: str, *key) -> Column:
    """1, a standard exponential or a uniform number, by kind."""
    if kind == "ones":
        return F.lit(1.0)
    if kind == "exp":
        return exponential(*key)
    if kind == "uniform":
        return uniform(*key)
    raise ValueError("kind must be 'ones', 'exp' or 'uniform'")


def ssbm(spark: SparkSession, n: int, k: int, pin: float, etain: float, pout: float | None = None, ratio: float = 2, etaout: float | None = None, values: str = "ones", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of an undirected signed block model: positive inside blocks and negative between, flipped by chance; both directions."""
    pout = pin if pout is None else pout
    etaout = etain if etaout is None else etaout
    nodes = assigned(spark, n, k, ratio, seed)
    chance = [[pin if i == j else pout for j in range(k)] for i in range(k)]
    found = pairs_below(nodes, chance, seed, n, upper=True)
    inside = F.col("k") == F.col("l")
    flip = uniform(seed, "sign", F.col("src"), F.col("dst")) < F.when(inside, etain).otherwise(etaout)
    w = weight(values, seed, "value", F.col("src"), F.col("dst"))
    one = found.select("src", "dst", (F.when(inside != flip, 1.0).otherwise(-1.0) * w).alias("w"))
    return one.unionByName(E.reverse(one)), nodes


def polarized(spark: SparkSession, total: int = 100, communities: int = 3, n: int = 30, k: int = 2, p: float = 0.1, eta: float = 0.1, ratio: float = 1, seed: int = 2020) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes (id, y, group)): signed block models inside a random signed graph, least degree 3 after repair.

    Ids are those of the random order; nodes outside all communities have y 0 and group 0. Only the largest
    component stays. Nodes of one edge get two more, nodes of two get one, to other nodes by hash order."""
    from .structure import largest_component

    sizes = block_sizes(n * communities, communities, ratio)
    if sum(sizes) > total:
        raise ValueError("communities do not fit")
    order = spark.range(total).withColumn("r", (F.row_number().over(Window.orderBy(hash_key(seed, "p", F.col("id")), "id")) - 1).cast("long"))
    base = spark.range(total).select("id", F.lit(0).alias("y"))
    ambient = pairs_below(base, [[p]], f"{seed}:a", total, upper=True).select("src", "dst", F.when(uniform(seed, "as", F.col("src"), F.col("dst")) < 0.5, 1.0).otherwise(-1.0).alias("w"))
    blocks, labels, at = [], [], 0
    for c, size in enumerate(sizes):
        e, m = ssbm(spark, size, k, p, eta, ratio=1, seed=seed + 1 + c)
        blocks.append(e.select((F.col("src") + at).alias("src"), (F.col("dst") + at).alias("dst"), "w"))
        labels.append(m.select((F.col("id") + at).alias("id"), (F.col("y") + 1 + c * k).alias("y"), F.lit(c + 1).alias("group")))
        at += size
    bound = F.array(*[F.lit(sum(sizes[: i + 1])) for i in range(len(sizes))])
    of = lambda v: F.size(F.filter(bound, lambda b: F.col(v) >= b))
    outside = ambient.filter((of("src") != of("dst")) | (of("src") == len(sizes)))
    whole = outside.unionByName(E.reverse(outside))
    nodes = order.select("id")
    for b in blocks:
        whole = whole.unionByName(b)
    tags = labels[0]
    for t in labels[1:]:
        tags = tags.unionByName(t)
    tags = nodes.join(tags, "id", "left").select("id", F.coalesce("y", F.lit(0)).alias("y"), F.coalesce("group", F.lit(0)).alias("group"))
    to = order.select(F.col("id").alias("old"), F.col("r").alias("new"))
    moved = whole.join(to.select(F.col("old").alias("src"), F.col("new").alias("s")), "src").join(to.select(F.col("old").alias("dst"), F.col("new").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w")
    tags = tags.join(to, tags.id == to.old).select(F.col("new").alias("id"), "y", "group")
    own = largest_component(moved, tags.select("id"))
    e, v = E.induced(moved, own), tags.join(own, "id", "left_semi")
    return repaired(e, v, seed), v


def repaired(edges: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """Edges, with new positive ones so that nodes of one or two neighbours come to three."""
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")).filter("d < 3")
    pairs = d.crossJoin(F.broadcast(nodes.select(F.col("id").alias("other")))).filter("id <> other")  # few nodes are of low degree
    fresh = pairs.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("other")), ["id", "other"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(hash_key(seed, "r", F.col("id"), F.col("other")), "other"))
    new = fresh.withColumn("r", rank).filter(F.col("r") <= 3 - F.col("d")).select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), F.lit(1.0).alias("w")).distinct()
    return edges.unionByName(new).unionByName(E.reverse(new))


def gaussian_features(nodes: DataFrame, dims: int, seed: int = 0) -> DataFrame:
    """(id, pos, val) of standard normal numbers."""
    a, b = uniform(seed, "g1", F.col("id"), F.col("pos")), uniform(seed, "g2", F.col("id"), F.col("pos"))
    return nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("pos")).select("id", "pos", (F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * math.pi * b)).alias("val"))
