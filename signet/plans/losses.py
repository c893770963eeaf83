"""Objectives as one-row aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signet.functions import hash_key, sigmoid, uniform
from signet.operators import laplacian as L
from signet.operators import propagate as P
from signet.operators.iterate import kept


def log_sigmoid(x):
    """log(1 / (1 + exp(-x))) without overflow."""
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def _one(df: DataFrame, value) -> DataFrame:
    return df.agg(value.alias("loss"))


def product_entropy(edges: DataFrame, z: DataFrame) -> DataFrame:
    """Sum of the logistic loss of z_u . z_v against the sign."""
    e = P.pair_dots(edges, z)
    return _one(e, F.sum(-log_sigmoid(F.when(F.col("w") > 0, F.col("dot")).otherwise(-F.col("dot")))))


def link_product(edges: DataFrame, z: DataFrame) -> DataFrame:
    """-(sum log s(p) over positive + C sum log s(-p) over negative), C the ratio of positive to negative edges."""
    e = P.pair_dots(edges, z)
    pos, neg = F.col("w") > 0, F.col("w") < 0
    return _one(e, -F.coalesce(F.sum(F.when(pos, log_sigmoid(F.col("dot")))), F.lit(0.0)) - F.coalesce(F.try_divide(F.count_if(pos).cast("double"), F.count_if(neg).cast("double")), F.lit(0.0)) * F.coalesce(F.sum(F.when(neg, log_sigmoid(-F.col("dot")))), F.lit(0.0)))


def direction(edges: DataFrame, z: DataFrame, a: list[float], b: list[float]) -> DataFrame:
    """Sum of squared misses of the status order: at most -1/2 apart for positive, at least 1/2 for negative edges."""
    vec = lambda v: F.element_at(F.array(*[F.lit(float(t)) for t in v]), F.col("pos") + 1)
    s = z.groupBy("id").agg(sigmoid(F.sum(vec(a) * F.col("val"))).alias("s1"), sigmoid(F.sum(vec(b) * F.col("val"))).alias("s2"))
    e = edges.join(s.select(F.col("id").alias("src"), "s1"), "src").join(s.select(F.col("id").alias("dst"), "s2"), "dst").withColumn("d", F.col("s1") - F.col("s2"))
    aim = F.when(F.col("w") > 0, F.least("d", F.lit(-0.5))).otherwise(F.greatest("d", F.lit(0.5)))
    return _one(e, F.sum((aim - F.col("d")) * (aim - F.col("d"))))


def _scores(pairs: DataFrame, z: DataFrame, weight: list[list[float]], bias: list[float], width: int) -> DataFrame:
    """pairs with linear scores s0, s1 ... of [z_u, z_v]: sums of both nodes' own parts. A node without a vector counts as 0, a pair of two is left out."""
    k = len(bias)
    col = lambda j, at: F.element_at(F.array(*[F.lit(float(r[j])) for r in weight]), F.col("pos").cast("int") + (1 + at))
    own = lambda end, at: z.groupBy(F.col("id").alias(end)).agg(*[F.coalesce(F.sum(col(j, at) * F.col("val")), F.lit(0.0)).alias(f"{end}{j}") for j in range(k)])
    both = pairs.join(own("src", 0), "src", "left").join(own("dst", width), "dst", "left").filter("src0 is not null or dst0 is not null")
    part = lambda name: F.coalesce(name, F.lit(0.0))
    return both.select(*pairs.columns, *[(part(f"src{j}") + part(f"dst{j}") + F.lit(float(bias[j]))).alias(f"s{j}") for j in range(k)])


def triangle(weights: DataFrame, edges: DataFrame, z: DataFrame, weight: list[list[float]], bias: list[float], width: int) -> DataFrame:
    """Triangle-weighted logistic loss of a linear score of the pair against the sign; the edges are not read where the weights have signs w."""
    signed = weights if "w" in weights.columns else edges.select("src", "dst", "w").join(weights, ["src", "dst"])
    e = _scores(signed, z, weight, bias, width)
    return _one(e, F.sum(F.col("tri") * -log_sigmoid(F.when(F.col("w") > 0, F.col("s0")).otherwise(-F.col("s0")))))


def link_entropy(edges: DataFrame, none: DataFrame, z: DataFrame, weight: list[list[float]], bias: list[float], width: int) -> DataFrame:
    """Mean of the three mean cross entropies: positive edges class 0, negative 1, sampled pairs without an edge 2."""
    pairs = edges.select("src", "dst", F.when(F.col("w") > 0, 0).otherwise(1).alias("y")).union(none.select("src", "dst", F.lit(2)))
    e = _scores(pairs, z, weight, bias, width)
    top = F.greatest("s0", "s1", "s2")
    lse = top + F.log(F.exp(F.col("s0") - top) + F.exp(F.col("s1") - top) + F.exp(F.col("s2") - top))
    own = F.when(F.col("y") == 0, F.col("s0")).when(F.col("y") == 1, F.col("s1")).otherwise(F.col("s2"))
    return _one(e.groupBy("y").agg(F.avg(lse - own).alias("m")), F.avg("m"))


def _distance(pairs: DataFrame, z: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """pairs(key, ...) with the squared distance of the nodes in columns a and b."""
    x = pairs.select("key", a, b).join(z.select(F.col("id").alias(a), "pos", F.col("val").alias("va")), a).join(z.select(F.col("id").alias(b), "pos", F.col("val").alias("vb")), [b, "pos"])
    return x.groupBy("key").agg(F.sum((F.col("va") - F.col("vb")) * (F.col("va") - F.col("vb"))).alias(name))


def structure(edges: DataFrame, negatives: DataFrame, z: DataFrame) -> DataFrame:
    """Hinges: a positive neighbour closer than a node without an edge, that closer than a negative neighbour; means added."""
    t = edges.join(negatives, ["src", "dst"]).withColumn("key", F.struct("src", "dst"))
    d = _distance(t, z, "src", "dst", "near").join(_distance(t, z, "src", "neg", "far"), "key").join(t.select("key", "w"), "key")
    gap = F.when(F.col("w") > 0, F.col("near") - F.col("far")).otherwise(F.col("far") - F.col("near"))
    d = d.withColumn("hinge", F.greatest(gap, F.lit(0.0))).groupBy((F.col("w") > 0).alias("s")).agg(F.avg("hinge").alias("m"))
    return _one(d, F.sum("m"))


def _forms(edges: DataFrame, nodes: DataFrame, p: DataFrame) -> DataFrame:
    """(pos, cut): p_k^T (D_p - A) p_k by column."""
    m = L.balance(edges, nodes)
    x = m.join(p.select(F.col("id").alias("src"), "pos", F.col("val").alias("a")), "src").join(p.select(F.col("id").alias("dst"), "pos", F.col("val").alias("b")), ["dst", "pos"])
    return x.groupBy("pos").agg(F.sum(F.col("a") * F.col("w") * F.col("b")).alias("cut"))


def balanced_ratio(edges: DataFrame, nodes: DataFrame, p: DataFrame) -> DataFrame:
    mass = p.groupBy("pos").agg(F.sum(F.col("val") * F.col("val")).alias("m"))
    return _one(_forms(edges, nodes, p).join(mass, "pos"), F.sum(F.col("cut") / (F.col("m") + 1)))


def balanced_normalized(edges: DataFrame, nodes: DataFrame, p: DataFrame) -> DataFrame:
    d = edges.groupBy(F.col("src").alias("id")).agg(F.sum(F.abs("w")).alias("d"))
    mass = p.join(d, "id", "left").groupBy("pos").agg(F.sum(F.col("val") * F.col("val") * F.coalesce("d", F.lit(0.0))).alias("m"))
    return _one(_forms(edges, nodes, p).join(mass, "pos"), F.sum(F.col("cut") / (F.col("m") + 1e-6)))


def unhappy_ratio(edges: DataFrame, nodes: DataFrame, p: DataFrame) -> DataFrame:
    """Cut over the number of directed edges."""
    return _forms(edges, nodes, p).agg(F.sum("cut").alias("c")).crossJoin(edges.agg(F.count("*").alias("m"))).select((F.col("c") / F.col("m")).alias("loss"))


def imbalance(edges: DataFrame, p: DataFrame, k: int, normalization: str = "vol_sum", threshold: str = "sort", selected: int | None = None) -> DataFrame:
    """1 less the mean imbalance of flows between clusters.

    normalization: vol_sum, vol_min, vol_max or plain; threshold: sort (the `selected` largest, divided by that
    number), std (pairs beyond three deviations, all where there is none) or naive. No pair: 1."""
    if normalization not in ("vol_sum", "vol_min", "vol_max", "plain") or threshold not in ("sort", "std", "naive"):
        raise ValueError("unknown normalization or threshold")
    if threshold == "sort" and selected is None:
        raise ValueError("sort needs the number of selected pairs")
    one = edges.join(p.select(F.col("id").alias("src"), F.col("pos").alias("k"), F.col("val").alias("a")), "src")
    half = one.groupBy("dst", "k").agg(F.sum(F.col("w") * F.col("a")).alias("f"))
    flow = half.join(p.select(F.col("id").alias("dst"), F.col("pos").alias("l"), F.col("val").alias("b")), "dst").groupBy("k", "l").agg(F.sum(F.col("f") * F.col("b")).alias("f"))
    both = edges.select(F.col("src").alias("id"), "w").union(edges.select("dst", "w")).groupBy("id").agg(F.sum("w").alias("d"))
    volume = p.join(both, "id").groupBy("pos").agg(F.sum(F.col("val") * F.col("d")).alias("v"))
    # K x K from here on
    pairs = flow.alias("x").join(flow.alias("y"), (F.col("x.k") == F.col("y.l")) & (F.col("x.l") == F.col("y.k")) & (F.col("x.k") < F.col("x.l"))).select(F.col("x.k").alias("k"), F.col("x.l").alias("l"), F.col("x.f").alias("f"), F.col("y.f").alias("g")).filter("f <> g")
    pairs = pairs.join(volume.select(F.col("pos").alias("k"), F.col("v").alias("vk")), "k").join(volume.select(F.col("pos").alias("l"), F.col("v").alias("vl")), "l")
    pairs = pairs.withColumns({"d": F.abs(F.col("f") - F.col("g")), "s": F.col("f") + F.col("g")})
    if normalization == "plain":
        value = F.try_divide(F.col("d"), F.col("s"))
    elif normalization == "vol_sum":
        value = 2 * F.col("d") / (F.col("vk") + F.col("vl") + 1e-8)
    elif normalization == "vol_max":
        value = F.col("d") / (F.greatest("vk", "vl") + 1e-8)
    else:
        top = volume.orderBy(F.desc("v")).limit(2).agg(F.min("v").alias("second"))
        pairs = pairs.crossJoin(top)
        value = F.try_divide(F.col("d"), F.col("s")) * F.least("vk", "vl") / (F.col("second") + 1e-8)
    pairs = pairs.withColumn("i", F.coalesce(value, F.lit(0.0)))
    if threshold == "sort":
        from pyspark.sql import Window

        best = pairs.withColumn("r", F.row_number().over(Window.orderBy(F.desc("i"), "k", "l"))).filter(F.col("r") <= selected)
        return best.agg(F.when(F.count("*") == 0, 1.0).otherwise(1 - F.coalesce(F.sum("i"), F.lit(0.0)) / selected).alias("loss"))
    if threshold == "std":
        wide = F.col("d") * F.col("d") > 9 * F.col("s")
        mean = F.coalesce(F.avg(F.when(wide, F.col("i"))), F.avg("i"))
    else:
        mean = F.avg("i")
    return _one(pairs, F.coalesce(1 - mean, F.lit(1.0)))


def triplet(labels: DataFrame, z: DataFrame, n_sample: int = 100, threshold: float = 0.1, classes: int | None = None, seed: int = 0) -> DataFrame:
    """Hinges of anchor . negative over anchor . positive plus a threshold, over drawn anchors, positives and negatives of each class."""
    from pyspark.sql import Window

    k = classes or labels.select("y").distinct().count()
    n = max(n_sample // k, 32)
    inside = labels.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("id")) - 1)
    size = labels.groupBy("y").agg(F.count("*").alias("m"))
    total = labels.agg(F.count("*").alias("t"))
    draws = size.crossJoin(total).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pick = lambda tag, of: F.floor(uniform(seed, tag, F.col("y"), F.col("d")) * of)
    draws = draws.select("y", "d", pick("a", F.col("m")).alias("ra"), pick("p", F.col("m")).alias("rp"), pick("n", F.col("t") - F.col("m")).alias("rn"), "m")
    # ranks of other classes' nodes: the ranks before the class, then those after it
    order = labels.withColumn("g", F.row_number().over(Window.orderBy("y", "id")) - 1)
    start = size.withColumn("lo", F.coalesce(F.sum("m").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("y", "lo")
    draws = draws.join(start, "y").withColumn("gn", F.when(F.col("rn") < F.col("lo"), F.col("rn")).otherwise(F.col("rn") + F.col("m")))
    a = inside.select("y", F.col("r").alias("ra"), F.col("id").alias("ia"))
    b = inside.select("y", F.col("r").alias("rp"), F.col("id").alias("ip"))
    c = order.select(F.col("g").alias("gn"), F.col("id").alias("in_"))
    t = draws.join(a, ["y", "ra"]).join(b, ["y", "rp"]).join(c, "gn").select("y", "d", "ia", "ip", "in_")
    near = P.pair_dots(t.select(F.col("ia").alias("src"), F.col("ip").alias("dst"), "y", "d"), z).select("y", "d", F.col("dot").alias("s"))
    far = P.pair_dots(t.select(F.col("ia").alias("src"), F.col("in_").alias("dst"), "y", "d"), z).select("y", "d", F.col("dot").alias("f"))
    both = near.join(far, ["y", "d"])
    return _one(both, F.sum(F.greatest(F.col("f") - F.col("s") + threshold, F.lit(0.0))) / (n * k))


#: Nodes of a block: products are taken for two blocks at a time.
BLOCK = 2048


def _vectors(column) -> tuple:
    """Rows of (pos, val) lists as a matrix, and which rows are there; places that a row lacks are 0."""
    import numpy as np

    rows = column.to_pylist()
    width = max((e["pos"] + 1 for r in rows if r for e in r), default=1)
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        for e in r or ():
            out[k, e["pos"]] = e["val"]
    return out, np.array([r is not None for r in rows])


def _blocked(table):
    """A block's nodes as one row: which of both views each node has, and the vectors of each view."""
    import pyarrow as pa

    (u, has_u), (v, has_v) = _vectors(table.column("u")), _vectors(table.column("v"))
    return pa.table({"block": table.column("block")[:1], "has": pa.array([(has_u + 2 * has_v).astype("uint8").tobytes()], pa.binary()), "u": pa.array([u.tobytes()], pa.binary()), "v": pa.array([v.tobytes()], pa.binary())})


def _matrices(has, u, v):
    """(u, v) of a block as matrices, and which nodes are in each."""
    import numpy as np

    has = np.frombuffer(has, np.uint8)
    return [(np.frombuffer(x, np.float64).reshape(len(has), -1), (has & bit) > 0) for x, bit in ((u, 1), (v, 2))]


def _block_sums(tau: float, batched: bool):
    """Pairs of blocks -> for each of both, its nodes' sums of exp(product / tau) over the other's: u with u, v with v and, batched, u with v and v with u."""

    def sums(a, b):
        import numpy as np

        (x, in_x), (y, in_y) = a, b
        width = min(x.shape[1], y.shape[1])
        e = x[:, :width] @ y[:, :width].T
        e /= tau
        np.exp(e, out=e)
        return e @ in_y.astype(float), in_x.astype(float) @ e

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                i, j = _matrices(r["has"], r["u"], r["v"]), _matrices(r["has2"], r["u2"], r["v2"])
                both = [(sums(i[a], j[b]), a, b) for a, b in ((0, 0), (1, 1), (0, 1), (1, 0))[: 4 if batched else 2]]
                # a row sum belongs to the first block's view a, a column sum to the second's view b
                mine = [rows for (rows, _), _, _ in both]
                other = [next(columns for (_, columns), c, d in both if (d, c) == (a, b)) for _, a, b in both]
                out = [(r["block"], r["block2"], np.stack(mine).tobytes())]
                if r["block"] != r["block2"]:
                    out.append((r["block2"], r["block"], np.stack(other).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], ["block", "with", "sums"])

    return run


def _block_losses(tau: float, batched: bool):
    """A block's vectors and all its sums -> (n, total) of the losses of its nodes that both views have."""

    def run(key, vectors, found):
        import numpy as np
        import pyarrow as pa

        r = vectors.to_pylist()[0]
        (u, in_u), (v, in_v) = _matrices(r["has"], r["u"], r["v"])
        parts = sorted(zip(found.column("with").to_pylist(), found.column("sums").to_pylist(), strict=True))
        total = sum(np.frombuffer(x, np.float64).reshape(-1, len(in_u)) for _, x in parts)
        width = min(u.shape[1], v.shape[1])
        own = lambda x, y: np.exp((x * y).sum(axis=1) / tau)
        cross = own(u[:, :width], v[:, :width])
        below = [total[k] + (total[2 + k] if batched else cross) - own(x, x) for k, x in enumerate((u, v))]
        each = (np.log(below[0] / cross) + np.log(below[1] / cross))[in_u & in_v] / 2
        return pa.table({"n": pa.array([len(each)], pa.int64()), "total": pa.array([float(each.sum())], pa.float64())})

    return run


def contrastive(z1: DataFrame, z2: DataFrame, tau: float = 0.4, batched: bool = False, mean: bool = True) -> DataFrame:
    """Symmetric contrastive loss of two views. batched: the denominator takes all of the other view, not the own pair alone.

    All pairs of nodes are work in the square of the nodes; they are taken as products of blocks of BLOCK nodes, so what is
    written is the vectors once for each block, and never a row for a pair."""
    packed = lambda z, name: P.l2_normalized(z).groupBy("id").agg(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), F.col("val").cast("double").alias("val"))).alias(name))
    nodes = packed(z1, "u").join(packed(z2, "v"), "id", "full_outer")
    blocks = max(1, -(-max(z1.select("id").distinct().count(), z2.select("id").distinct().count()) // BLOCK))
    dealt = nodes.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "u", "v")
    block = kept(dealt.groupBy("block").applyInArrow(_blocked, "block int, has binary, u binary, v binary"))
    left = block.withColumn("block2", F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))))
    right = block.select(F.col("block").alias("block2"), F.col("has").alias("has2"), F.col("u").alias("u2"), F.col("v").alias("v2"))
    pairs = left.join(right, "block2").repartition(min(1000, blocks * (blocks + 1) // 2), "block", "block2")
    sums = pairs.mapInArrow(_block_sums(tau, batched), "block int, with int, sums binary")
    both = block.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_block_losses(tau, batched), "n long, total double")
    return _one(both, F.sum("total") / F.sum("n") if mean else F.sum("total"))


def nll(log_p: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean of -log p at the label."""
    return _one(log_p.join(labels.select("id", F.col("y").alias("pos")), ["id", "pos"]), -F.avg("val"))


def shuffled(labels: DataFrame, seed: int) -> DataFrame:
    """Ids in a random order, for draws."""
    return labels.orderBy(hash_key(seed, F.col("id")), "id")
