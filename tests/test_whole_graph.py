"""Registered queries work on the whole graph: brute force over all edges of the smallest tables."""

import datetime
import os
import random
from collections import Counter

import pytest

from signet.operators import splits
from signet.plans import registry, registry_more

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def run(spark):
    if not registry.QUERIES:
        registry.register()
    return lambda name: registry.QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def adj(run):
    return {(r.src, r.dst): r.w for r in run("edges_derived")}


def components(pairs, nodes):
    parent = {v: v for v in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {v: find(v) for v in nodes}


def core(pairs, nodes, least, rounds=10):
    ids = set(nodes)
    for _ in range(rounds):
        d = Counter(x for p in pairs if set(p) <= ids for x in p)
        ids = {v for v in ids if d[v] >= least}
    return ids or core(pairs, nodes, least - 1, rounds)


def test_components_forest_and_core(run, adj):
    nodes = {x for p in adj for x in p}
    want = components(adj, nodes)
    assert {r.id: r.component for r in run("weak_components")} == want
    n, top = max((n, -c) for c, n in Counter(want.values()).items())
    largest = {v for v, c in want.items() if c == -top}
    assert {r.id for r in run("largest_component")} == largest and len(largest) == n
    tree = [(r.src, r.dst) for r in run("spanning_forest")]
    assert len(tree) == len(nodes) - len(set(want.values())) and components(tree, nodes) == want
    assert all(p in adj or p[::-1] in adj for p in tree)
    assert {r.id for r in run("kcore_peel")} == core(adj, nodes, 4)
    kept = core([p for p in adj if set(p) <= largest], largest, 3)
    assert {(r.src, r.dst): r.w for r in run("extract_network")} == {p: w for p, w in adj.items() if set(p) <= kept}


@pytest.fixture(scope="module")
def sparse(spark, tmp_path_factory):
    """A folder of events by 400 users, so of a graph with more nodes than sf0.01's."""
    draw, at = random.Random(3), datetime.datetime(2024, 1, 1)
    rows = [(at + datetime.timedelta(minutes=i), i, i % 400 if i < 400 else draw.randrange(400), draw.choice(["view", "error"])) for i in range(1200)]
    folder = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "ts timestamp, event_id long, user_id long, event_type string").write.parquet(f"{folder}/events.parquet")
    return folder


def test_negatives_come_from_all_nodes(spark, run, sparse):
    f = registry.Fixture(spark, sparse)
    adj = {(r.src, r.dst): r.w for r in f.g.collect()}
    linked = set(adj) | {p[::-1] for p in adj}
    ask = lambda name: registry.QUERIES[name](spark, sparse).collect()
    found = {"negative_sampling": [(r.src, r.dst) for r in ask("negative_sampling")]}
    for task, label in (("existence", 1), ("five_class_signed_digraph", 4)):
        # the forest's reversed edges are of no drawn pair
        found[task] = [(r.src, r.dst) for r in ask(f"link_split_{task}") if r.label == label and (r.dst, r.src) not in adj]
    for pairs in found.values():
        assert len(set(pairs)) == len(pairs) == len(adj) and not linked & set(pairs)
        assert all(0 <= x < 400 for p in pairs for x in p) and max(map(max, pairs)) > 390
    for rows in (ask("structured_negatives"), registry_more._negatives(f).collect()):
        assert max(r.neg for r in rows) > 390 and all(r.neg < 400 and (r.src, r.dst) in adj for r in rows)


def test_dense_graphs_get_all_negatives(spark):
    n = 40
    rows = [(0, b, 1.0) for b in range(38)] + [(1, b, 1.0) for b in range(n)] + [(a, b, 1.0) for a in range(2, n) for b in range(n) if a != b and (a * b) % 9]
    e = spark.createDataFrame(rows, "src long, dst long, w double")
    adj = {(a, b) for a, b, _ in rows}
    free = {(a, b) for a in range(n) for b in range(n) if a != b and (a, b) not in adj and (b, a) not in adj}
    for count in (len(free) - 5, len(free) + 5):
        got = [(r.src, r.dst) for r in splits.negative_samples(e, n, count).collect()]
        assert len(got) == len(set(got)) == min(count, len(free)) and set(got) <= free
    got = splits.structured_negatives(e, n).collect()
    assert {(r.src, r.dst) for r in got} == {p for p in adj if p[0] != 1} and len(got) == len(adj) - n
    assert all(0 <= r.neg < n and (r.src, r.neg) not in adj for r in got)
    assert {r.neg for r in got if r.src == 0} == {38, 39}


def test_pairs_are_all_edges(spark, run, adj):
    probed = {(r.src, r.dst): (r.w, r.w_rev) for r in run("edge_probe")}
    assert probed == {(b, a): (adj.get((b, a), 0), w) for (a, b), w in adj.items()}
    assert {(r.src, r.dst, r.pos) for r in run("pair_gather")} == {(a, b, k) for a, b in adj for k in range(8)}
    assert {(r.src, r.dst) for r in run("fwd_sssnet_link")} == set(adj)


def test_absent_class_of_link_entropy(spark, sparse):
    f = registry.Fixture(spark, sparse)
    linked = {(r.src, r.dst) for r in f.g.collect()}
    none = {(r.src, r.dst) for r in registry_more._unlinked(f).collect()}
    assert len(none) == len(linked) and not any(p in linked or p[::-1] in linked for p in none)
    # every node takes part, in numbers that no residue of the ids sets
    assert len({(a * 31 + b * 17) % 97 for a, b in none}) > 90
