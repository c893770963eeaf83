"""Results over pairs of nodes that are found without a row for each pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signet.operators import edges as E
from signet.operators import proximity
from signet.plans import layers, losses, models


def _graph(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, w double")


def _values(df):
    return {(r.id, r.pos): r.val for r in df.collect()}


def test_factors_equal_pairs(spark):
    rng = np.random.default_rng(5)
    rows = {(int(a), int(b)): float(rng.choice([1.0, 2.0, -1.0])) for a, b in rng.integers(0, 25, (90, 2))} | {(30, 30): 1.0, (40, 41): 2.0}
    g = _graph(spark, [(a, b, w) for (a, b), w in rows.items()]).cache()
    u = E.unweighted(g, False)
    nodes = spark.range(45)  # with nodes that have no edge
    x = nodes.select("id", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("pos")).select("id", "pos", ((F.col("id") * 7 + F.col("pos") * 5) % 11 - 4.5).alias("val"))
    for way in ("in", "out"):
        pairs, factors = proximity.in_out_proximity(g, way), proximity.InOut(g, way)
        want = {}
        for r in pairs.collect():
            want[r.dst] = want.get(r.dst, 0.0) + r.w * ((r.src * 7) % 11 - 4.5)
        got = {r.id: r.v for r in factors.times(x.filter("pos = 0").select("id", F.col("val").alias("v"))).collect()}
        assert got == pytest.approx(want)
        want = _values(layers.dgcn_conv(proximity.in_out_proximity(u, way), nodes, x))
        factors = proximity.InOut(u, way)
        assert _values(layers.in_out_conv(factors, factors.symmetric(nodes), x, 3)) == pytest.approx(want)


def test_dgcn_of_a_hub(spark):
    """A hub of 20,000 edges has 400,000,000 pairs in one proximity."""
    n = 20_000
    g = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    nodes = spark.range(n + 1)
    x = nodes.select("id", F.lit(0).alias("pos"), F.lit(1.0).alias("val"))
    one = [[1.0], [1.0], [1.0]]
    z, width = models.dgcn_trunk(E.to_undirected(g).withColumn("w", F.lit(1.0)), proximity.InOut(g, "in"), proximity.InOut(g, "out"), nodes, x, [[1.0]], one)
    got = _values(z)
    assert width == 3 and len(got) == 3 * (n + 1)
    # all leaves are alike: the normalised sums are of one value over n equal places
    assert got[1, 1] == pytest.approx(got[n, 1]) and got[1, 1] > 0


def _numpy_loss(a, b, tau, batched):
    a, b = (x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12) for x in (a, b))

    def half(p, q):
        r, s = np.exp(p @ p.T / tau), np.exp(p @ q.T / tau)
        return -np.log(np.diag(s) / (r.sum(axis=1) + (s.sum(axis=1) if batched else np.diag(s)) - np.diag(r)))

    return (half(a, b) + half(b, a)) / 2


@pytest.mark.parametrize("batched", [False, True])
def test_contrastive(spark, batched, monkeypatch):
    def view(n, shift):
        at = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
        return at.select("id", "pos", ((F.col("id") * (5 + F.col("pos")) + shift * 3) % 17 - 7.5 + F.col("id") / n + shift * 0.3).alias("val"))

    def table(n, shift):
        i, p = np.arange(n)[:, None], np.arange(3)[None, :]
        return (i * (5 + p) + shift * 3) % 17 - 7.5 + i / n + shift * 0.3

    for n, block in ((50, 7), (1, 2048), (8_000, 2048)):  # the last: 64,000,000 pairs in each of two to four products
        monkeypatch.setattr(losses, "BLOCK", block)
        want = _numpy_loss(table(n, 0), table(n, 1), 0.4, batched)
        assert losses.contrastive(view(n, 0), view(n, 1), 0.4, batched).first().loss == pytest.approx(want.mean(), rel=1e-9)
    assert losses.contrastive(view(50, 0), view(50, 1), 0.4, batched, mean=False).first().loss == pytest.approx(_numpy_loss(table(50, 0), table(50, 1), 0.4, batched).sum())
    assert losses.contrastive(view(0, 0), view(0, 1), 0.4, batched).first().loss is None
