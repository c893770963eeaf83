"""Micro graphs with results by hand, invariants of splits and generators, and readers of files."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signet.graph import Graph
from signet.operators import edges as E
from signet.operators import generators as G
from signet.operators import laplacian as L
from signet.operators import spectral, splits, structure
from signet.operators import propagate as P
from signet.plans import evaluate, losses, metrics, models, registry, train
from signet.sources import readers


def graph(spark, rows, n=None):
    return Graph.from_edges(spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, w double"), n=n)


def test_balanced_triangle(spark):
    g = graph(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 1)])
    census = {(r.src, r.dst): r for r in structure.triad_census(g.edges).collect()}
    assert census[0, 1].d2_1 == 1 and census[1, 2].d4_1 == 1 and census[1, 2].d3_1 == 0
    assert census[0, 2].d1_1 == 1 and sum(census[0, 2][2:]) == 1


def test_unbalanced_weights(spark):
    g = graph(spark, [(0, 1, 1), (1, 2, -1), (0, 2, 1)])
    got = {(r.src, r.dst): r.tri for r in structure.triangle_weights(g.edges).collect()}
    assert got[0, 2] == 0 and set(got) == {(0, 1), (1, 2), (0, 2)}


def test_cancelled_entries_stay(spark):
    g = graph(spark, [(0, 1, 1), (1, 0, -1), (1, 2, 2), (2, 1, 2)])
    m = {(r.src, r.dst): r for r in g.magnetic_laplacian(signed=True).collect()}
    assert m[0, 1].re == 0 and m[0, 0].re == 1
    assert math.isclose(m[1, 2].re, -2 / math.sqrt(3 * 2)) and math.isclose(m[1, 2].im, 0, abs_tol=1e-12)


def test_magnetic_laplacian_is_hermitian(spark):
    g = graph(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1), (0, 2, 1)])
    m = {(r.src, r.dst): complex(r.re, r.im) for r in g.magnetic_laplacian(q=0.2).collect()}
    assert all(abs(m[b, a].conjugate() - v) < 1e-12 for (a, b), v in m.items())
    dense = np.array([[m.get((a, b), 0) for b in range(3)] for a in range(3)])
    value = spectral.lambda_max(g.magnetic_laplacian(q=0.2), g.nodes)
    assert abs(value - max(np.linalg.eigvalsh(dense), key=abs)) < 1e-4


def test_isolated_nodes_and_degrees(spark):
    g = graph(spark, [(0, 1, 1), (1, 2, -2)], n=4)
    got = {r.id: (r.row_sum, r.col_sum) for r in g.degrees().collect()}
    assert got == {0: (1, 0), 1: (2, 1), 2: (0, 2), 3: (0, 0)}
    assert g.is_signed and g.is_directed and g.summary().first().n_nodes == 4


def test_empty_sign_part(spark):
    assert not graph(spark, [(0, 1, 1)]).is_weighted(signed=True)


def test_components_and_core(spark):
    g = graph(spark, [(0, 1, 1), (2, 3, 1), (3, 4, 1), (4, 2, 1)])
    assert {r.id: r.component for r in structure.weak_components(g.edges, g.nodes).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2}
    assert sorted(r.id for r in g.extract().nodes.collect()) == [2, 3, 4]
    forest = structure.spanning_forest(g.edges, g.nodes).collect()
    assert len(forest) == 3


def test_spanning_forest_joins_all(spark):
    rows = [(i, (i * 7 + 3) % 40, 1) for i in range(40)] + [(i, (i * 11 + 5) % 40, 1) for i in range(40)]
    g = graph(spark, [r for r in rows if r[0] != r[1]], n=40)
    label = {r.id: r.component for r in structure.weak_components(g.edges, g.nodes).collect()}
    tree = structure.spanning_forest(g.edges, g.nodes).collect()
    parent = list(range(40))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in tree:
        assert find(r.src) != find(r.dst)
        parent[find(r.src)] = find(r.dst)
    assert len({find(x) for x in range(40)}) == len(set(label.values()))


@pytest.mark.parametrize("style", ["path", "cyclic", "complete", "star", "multipartite"])
@pytest.mark.parametrize("ambient", [False, True])
def test_meta_graphs(style, ambient):
    for k in (4, 5, 9, 10):
        f = G.meta_graph(style, k, 0.1, ambient)
        assert len(f) == k and all(len(r) == k and all(0 <= v <= 1 for v in r) for r in f)
        arcs = [(i, j) for i in range(k) for j in range(k) if i != j and f[i][j] == 0.9]
        assert arcs and all(math.isclose(f[j][i], 0.1) for i, j in arcs)


def test_block_sizes():
    assert sum(G.block_sizes(100, 3, 1.5)) == 100 and G.block_sizes(10, 3) == [3, 3, 4]


def test_generators(spark):
    e, v = G.sdsbm(spark, 60, 3, 0.3, [[0.5, 0.9, -0.1], [0.1, 0.5, 0.9], [-0.9, 0.1, 0.5]], 1.5, 0.1, 4)
    assert {abs(r.w) for r in e.collect()} == {1.0} and v.count() == 60
    e, v = G.ssbm(spark, 60, 3, 0.3, 0.1)
    assert E.predicates(e).first().is_directed is False
    e, v = G.polarized(spark, 60, 2, 20, 2, 0.15)
    assert e.groupBy("src").count().agg(F.min("count")).first()[0] >= 3 and {r.group for r in v.collect()} <= {0, 1, 2}


def test_node_split_counts(spark):
    labels = spark.range(90).select("id", (F.col("id") % 3).cast("int").alias("y"))
    got = splits.node_split(labels, 2, train_per_class=5, val=0.2, seed_per_class=0.4).groupBy("split", "role").agg(F.count("*").alias("n"), F.count_if("seed").alias("s")).collect()
    n = {(r.split, r.role): (r.n, r.s) for r in got}
    assert n == {(s, role): v for s in (0, 1) for role, v in (("train", (15, 15)), ("val", (15, 0)), ("test", (60, 0)))}
    with pytest.raises(ValueError):
        splits.node_split(labels, 2, train=5, train_per_class=5)
    with pytest.raises(ValueError):
        splits.node_split(labels, 2)


def test_link_split_invariants(spark):
    e, v = G.dsbm(spark, 40, 2, 0.3, [[0.5, 0.9], [0.1, 0.5]], seed=2)
    g = Graph.from_edges(e, v, 40)
    adj = {(r.src, r.dst): r.w for r in g.edges.collect()}
    links, seen = g.link_split("direction", splits=1)
    for r in links.collect():
        assert ((r.src, r.dst) in adj) == (r.label == 0) and ((r.dst, r.src) in adj) == (r.label == 1)
    obs = {(r.src, r.dst): r.w for r in seen.collect()}
    assert all(adj[k] == w for k, w in obs.items()) and len(obs) < len(adj)
    touched = {x for k in obs for x in k}
    assert all(r.src in touched and r.dst in touched for r in links.collect())
    with pytest.raises(ValueError):
        g.link_split("sign")


def test_link_split_quotas(spark):
    """Shares of a sign are rounded half to even of the share of all edges; too few loose edges are an error."""
    rows = [(i, i + 1, 1.0 if i < 30 else -1.0) for i in range(50)]
    e, v = spark.createDataFrame(rows, "src long, dst long, w double"), spark.range(51).select("id")
    links, _ = splits.link_split(e, v, 51, "sign", splits=1, prob_test=0.25, prob_val=0.05, maintain_connect=False)
    n = {(r.part, r.label): r.n for r in links.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    # 0.25 * 50 * 0.6 = 7.5 -> 8; 0.25 * 50 * 0.4 = 5; 0.05 * 50 * 0.6 = 1.5 -> 2; 0.05 * 50 * 0.4 = 1
    assert n == {("test", 1): 8, ("test", 0): 5, ("val", 1): 2, ("val", 0): 1, ("train", 1): 20, ("train", 0): 14}
    with pytest.raises(ValueError):
        splits.link_split(e, v, 51, "sign", splits=1)
    with pytest.raises(ValueError):
        splits.sample_per_class(v.withColumn("y", F.lit(0)), 52)


def test_link_weights_and_mutual_pairs(spark):
    e = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0), (1, 2, -4.0)], "src long, dst long, w double")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "src long, dst long")
    got = splits.link_labels(pairs, e, "five_class_signed_digraph", weights=True).collect()
    assert {tuple(r) for r in got} == {(1, 2, 1, -4.0), (2, 1, 3, -4.0), (0, 2, 4, 0.0)}
    assert [tuple(r) for r in splits.mutual_pairs(pairs, e).collect()] == [(0, 1)]


def test_numbers_in_two_levels(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    got = splits.by_hash(rows, ["g"], F.md5(F.col("id").cast("string")), ["id"]).collect()
    for g in range(3):
        own = sorted((r.r, r.id) for r in got if r.g == g)
        assert [r for r, _ in own] == list(range(1, len(own) + 1))
        want = sorted((i for i in range(500) if i % 3 == g), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert [i for _, i in own] == want


def test_sparsify_keeps_ties(spark):
    m = spark.createDataFrame([(0, 1, 3.0), (1, 0, -3.0), (1, 1, 1.0)], "src long, dst long, w double")
    assert E.sparsify(m, 2, 0.25).count() == 2
    with pytest.raises(ValueError):
        E.sparsify(m, 2, 0.1)


def test_spectral_residuals(spark):
    e, v = G.ssbm(spark, 40, 2, 0.4, 0.05, seed=5)
    lap = L.signed_laplacian(e, v.select("id"))
    matvec = lambda x: P.spmm(lap, x, to="src")
    values, x = spectral.leading(matvec, v.select("id"), 2, 40)
    dense = np.zeros((40, 40))
    for r in lap.collect():
        dense[r.src, r.dst] = r.w
    assert abs(values[0] - np.linalg.eigvalsh(dense)[-1]) < 1e-2
    assert spectral.hermitian_features(e.limit(100), v.select("id"), 1, 3).count() == 80


def test_losses_are_finite(spark):
    e, v = G.ssbm(spark, 30, 2, 0.4, 0.1, seed=6)
    z = G.gaussian_features(v.select("id"), 3)
    assert losses.product_entropy(e, z).first().loss >= 0 and losses.triplet(v, z, 20, 0.1, 2).first().loss >= 0
    assert losses.structure(e, splits.structured_negatives(e, 30), z).first().loss >= 0


def test_training_learns(spark):
    e, v = G.ssbm(spark, 40, 2, 0.5, 0.0, pout=0.02, seed=8)
    s = L.symmetric_normalized(e.filter("w > 0"), v.select("id"))
    x = P.one_hot(v.select("id", F.col("id").cast("int").alias("y")), 40)
    model = train.NodeClassifier(40, 4, 2)
    history = model.fit(s, x, v, epochs=6, rate=0.2)
    assert history[-1] < history[0] * 0.8


def test_evaluators(spark):
    v = spark.range(40).select("id", (F.col("id") % 2).cast("int").alias("y"))
    z = v.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"), "y").select("id", "pos", (F.col("y") * 2.0 - 1 + F.col("pos") * 0.1 + (F.col("id") % 5) * 0.01).alias("val"))
    pairs = v.select(F.col("id").alias("src"), ((F.col("id") * 3 + 2) % 40).alias("dst"), "y")
    assert evaluate.link_sign(pairs, pairs, z, 2).first().accuracy > 0.9
    assert evaluate.node_classes(z, v, v.filter("id < 30"), None, (0,), 2).first().accuracy > 0.9


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, pred int")
    got = metrics.classification(rows).first()
    assert got.accuracy == 0.75 and math.isclose(got.f1_binary, 2 / 3) and math.isclose(got.f1_macro, (0.8 + 2 / 3) / 2)
    assert metrics.adjusted_rand(rows.select("y", F.col("y").alias("pred"))).first().ari == 1


def test_readers(spark, tmp_path):
    (tmp_path / "e.csv").write_text("b,a,1.5\na,c,-2\n")
    e, ids = readers.read_edge_csv(spark, str(tmp_path / "e.csv"))
    assert {r.raw: r.id for r in ids.collect()} == {"b": 0, "a": 1, "c": 2} and {(r.src, r.dst, r.w) for r in e.collect()} == {(0, 1, 1.5), (1, 2, -2.0)}
    (tmp_path / "g.json").write_text('{"features": [[1, 0], [0, 1]], "labels": [3, 4], "links": [[1], []], "train_masks": [[true, false]], "test_mask": [false, true]}')
    got = readers.load(spark, "JSON", str(tmp_path / "g.json"))
    assert got["edges"].count() == 1 and got["features"].count() == 4 and got["masks"].count() == 2
    np.savez(tmp_path / "m.npz", row=[0, 1], col=[1, 0], data=[1.0, 0.0], shape=[2, 2])
    assert readers.load(spark, "npz", str(tmp_path / "m.npz")).count() == 1
    np.save(tmp_path / "d.npy", np.array([[0, 2.0], [0, 0]]))
    assert readers.load(spark, "npy", str(tmp_path / "d.npy")).first().w == 2
    (tmp_path / "n.tsv").write_text("id\tfeature\tlabel\n0\t1,2\t1\n")
    assert readers.read_node_tsv(spark, str(tmp_path / "n.tsv")).first().x == [1.0, 2.0]
    np.savez(tmp_path / "s.npz", train_mask=[True, False], val_mask=[False, True], test_mask=[False, False])
    assert {(r["name"], r.id) for r in readers.read_masks_npz(spark, str(tmp_path / "s.npz")).collect()} == {("train_mask", 0), ("val_mask", 1)}
    with pytest.raises(NameError):
        readers.load(spark, "none", "")


def test_streaming_degrees(spark, tmp_path):
    from signet.streaming import signed_degrees

    spark.createDataFrame([(0, 1.0), (0, -2.0), (1, 3.0)], "src long, w double").write.parquet(str(tmp_path / "in"))
    q = signed_degrees(spark.readStream.schema("src long, w double").parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("deg").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("deg").collect()} == {(0, 1.0, 2.0), (1, 3.0, 0.0)}


def test_registry_has_no_gaps():
    if not registry.QUERIES:
        registry.register()
    assert set(registry.SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 150
    assert models.fixed(2, 2) == [[-0.6, -0.2], [-0.1, 0.3]]


def test_motif_attention_equals_single_lists(spark):
    from signet.plans import layers as Y

    e = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 2, 0), (1, 2, 1)], "motif int, src long, dst long")
    nodes = spark.range(3)
    x = G.gaussian_features(nodes, 2)
    gats = [(models.fixed(2, 2), [0.1, -0.2], [0.3, 0.1]), ([[0.2, 0.1], [-0.3, 0.4]], [0.5, 0.1], [0.2, 0.2])]
    got = {(r.id, r.pos): r.val for r in Y.motif_attention(e, nodes, x, gats).collect()}
    for k, (w, a, b) in enumerate(gats):
        for r in Y.gat_conv(e.filter(F.col("motif") == k), nodes, x, w, a, b).collect():
            assert math.isclose(got[r.id, 2 * k + r.pos], r.val, abs_tol=1e-12)
