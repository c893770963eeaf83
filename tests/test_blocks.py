"""Triads and proximities by blocks of nodes: equal to brute force, and no row for two edges that meet."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signet.operators import blocks, proximity, structure
from signet.plans import layers, losses, models


def _graph(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, w double")


def _random(seed=3, nodes=40, n=420):
    rng = np.random.default_rng(seed)
    name = lambda k: int(k) * 10**15 - 7 * 10**15  # noqa: E731  ids far apart, some below 0
    return [(name(a), name(b), float(w)) for (a, b), w in {(a, b): rng.choice([2.0, 1.0, -1.0, -3.0]) for a, b in rng.integers(0, nodes, (n, 2))}.items()]


def _hub(spark, n):
    """Node 0 to n leaves, of which 1 and 2 are linked: pairs of an edge and a neighbour of its source are n squared."""
    star = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    return star.union(_graph(spark, [(1, 2, -1.0)]))


def _census(rows):
    adj = {}
    for a, b, w in rows:
        adj.setdefault(a, set()).add((b, "out", np.sign(w)))
        adj.setdefault(b, set()).add((a, "in", np.sign(w)))
    found = {}
    for a, b, _ in rows:
        met = Counter((du, dv, su, sv) for t, du, su in adj[a] for r, dv, sv in adj[b] if r == t)
        found[a, b] = [met[du, dv, su, sv] for du, dv in structure.TRIADS for su, sv in structure.SIGNS]
    return found


@pytest.mark.parametrize("least", [4, 1 << 16])
def test_triad_census(spark, monkeypatch, least):
    monkeypatch.setattr(blocks, "LEAST", least)  # 16 blocks, or one
    rows = _random()
    found = structure.triad_census(_graph(spark, rows)).collect()
    assert {(r.src, r.dst): list(r)[2:] for r in found} == _census(rows) and len(found) == len(rows)
    assert any(a == b for a, b, _ in rows)
    # edges without an endpoint stay, with zeros; so does a graph without edges
    odd = structure.triad_census(_graph(spark, [(None, 1, 1.0), (1, 2, 1.0)])).collect()
    assert sorted((str(r.src), r.dst, sum(list(r)[2:])) for r in odd) == [("1", 2, 0), ("None", 1, 0)]
    assert structure.triad_census(_graph(spark, [])).collect() == []


def test_triads_of_a_hub(spark):
    n = 50_000
    census = structure.triad_census(_hub(spark, n))
    r = census.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in census.columns[2:]]).first()
    assert r.n == n + 1 and sum(list(r)[1:]) == 3
    assert (r.d4_1, r.d1_2, r.d2_2) == (1, 1, 1)


def test_triangle_weights(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 4)
    rows = _random(5)
    g, census = _graph(spark, rows), _census(rows)
    name = [f"d{i}_{j}" for i in range(1, 5) for j in range(1, 5)]
    want = {(a, b): sum(n for n, c in zip(census[a, b], name, strict=True) if c in (structure.UNBALANCED if w < 0 else structure.BALANCED)) for a, b, w in rows}
    assert {(r.src, r.dst): r.tri for r in structure.triangle_weights(g).collect()} == want
    assert {(r.src, r.dst): r.tri for r in structure.triangle_weights(g, structure.triad_census(g)).collect()} == want
    assert {(r.src, r.dst): (r.w, r.tri) for r in structure.triangle_weights(g, signs=True).collect()} == {(a, b): (np.sign(w), want[a, b]) for a, b, w in rows}
    hub = structure.triangle_weights(_hub(spark, 50_000)).agg(F.count("*").alias("n"), F.sum("tri").alias("t")).first()
    assert tuple(hub) == (50_001, 0)


def test_loss_triangle(spark):
    """No row for each position of an edge's vectors, and weights that bring the signs are not joined with the edges."""
    rows, w, bias = _random(6), [[0.3], [-0.2], [0.5], [0.1]], [0.1]
    g = _graph(spark, rows)
    ids = sorted({v for a, b, _ in rows for v in (a, b)})
    z = {v: (k % 5 - 2.0, k % 3 / 2) for k, v in enumerate(ids)}
    vectors = spark.createDataFrame([(v, p, x) for v, xs in z.items() for p, x in enumerate(xs)], "id long, pos int, val double")
    tri = {(r.src, r.dst): r.tri for r in structure.triangle_weights(g).collect()}
    score = {(a, b): sum(x * r[0] for x, r in zip(z[a] + z[b], w, strict=True)) + 0.1 for a, b, _ in rows}
    want = sum(tri[a, b] * np.log1p(np.exp(-np.sign(s) * score[a, b])) for a, b, s in rows)
    assert losses.triangle(structure.triangle_weights(g), g, vectors, w, bias, 2).first().loss == pytest.approx(want)
    assert losses.triangle(structure.triangle_weights(g, signs=True), g, vectors, w, bias, 2).first().loss == pytest.approx(want)
    plan = losses._scores(g, vectors, w, bias, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "Union" not in plan


def test_motif_edges(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 4)
    rows = _random(7)
    want = Counter()
    for k, sign in enumerate((1, -1)):
        own = {(a, b) for a, b, w in rows if w * sign > 0}
        want.update((3 * k, a, b) for a, b in own | {(b, a) for a, b in own})
        want.update((3 * k + 1, a, b) for a, b in own)
        want.update((3 * k + 2, b, a) for a, b in own)
        want.update((6 + 16 * k + j, a, b) for (a, b), counts in _census(rows).items() if (a, b) in own for j, n in enumerate(counts) if n)
    found = structure.motif_edges(_graph(spark, rows))
    assert Counter(tuple(r) for r in found.collect()) == want
    n = 50_000
    hub = {r.motif: r["count"] for r in structure.motif_edges(_hub(spark, n)).groupBy("motif").count().collect()}
    assert hub == {0: 2 * n, 1: n, 2: n, 3: 2, 4: 1, 5: 1, 7: 1, 11: 1, 34: 1}


@pytest.mark.parametrize("least", [4, 1 << 16])
def test_second_order(spark, monkeypatch, least):
    monkeypatch.setattr(blocks, "LEAST", least)
    rows = [(a, b, abs(w)) for a, b, w in _random(8, 60, 150)]
    ids = sorted({v for a, b, _ in rows for v in (a, b)} | {5})  # 5 has no edge
    place = {v: k for k, v in enumerate(ids)}
    p = np.eye(len(ids))
    for a, b, w in rows:
        p[place[a], place[b]] += w
    there = (p > 0).astype(float)
    p /= p.sum(axis=1, keepdims=True)
    m = np.where((there.T @ there > 0) & (there @ there.T > 0), (p.T @ p + p @ p.T) / 2, 0)
    r = m.sum(axis=1) ** -0.5
    m = r[:, None] * m * r[None, :]
    found = {(x.src, x.dst): x.w for x in proximity.second_order(_graph(spark, rows), spark.createDataFrame([(v,) for v in ids], "id long")).collect()}
    assert found == pytest.approx({(ids[i], ids[j]): m[i, j] for i, j in zip(*np.nonzero(m), strict=True)})


def test_sigat(spark, monkeypatch):
    """Equal to attention over rows of the 38 lists, which the model no longer makes."""
    monkeypatch.setattr(blocks, "LEAST", 4)
    rows = _random(9, 20, 80)
    g = _graph(spark, rows).cache()
    nodes = spark.createDataFrame([(v,) for v in {v for a, b, _ in rows for v in (a, b)} | {5}], "id long")
    x = nodes.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).select("id", "pos", (F.pmod(F.col("id") * 7 + F.col("pos") * 3, F.lit(11)) - 5.0).alias("val"))
    gats = [(models.fixed(2, 2), [0.1 * (k % 5), -0.4], [0.3, 0.02 * k]) for k in range(38)]
    value = lambda df: {(r.id, r.pos): r.val for r in df.collect()}
    want = value(layers.motif_attention(structure.motif_edges(g), nodes, x, gats))
    assert value(structure.motif_attention(g, nodes, x, gats)) == pytest.approx(want) and len(want) == 76 * nodes.count()
    monkeypatch.setattr(structure, "motif_edges", None)
    assert models.sigat(g, nodes, x, 2, gats, models.fixed(78, 3), [0.1] * 3, models.fixed(3, 2), [0.0] * 2).count() == 2 * nodes.count()
