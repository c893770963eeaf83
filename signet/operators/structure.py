"""Triads, motifs, components, cores and spanning forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .edges import induced
from .iterate import kept

#: Sign patterns in the order of their numbers: sign between u and the third node, then between it and v.
SIGNS = ((1, 1), (1, -1), (-1, 1), (-1, -1))
#: Orientations: the third node as seen from u and from v.
TRIADS = (("out", "in"), ("out", "out"), ("in", "out"), ("in", "in"))
# The triads that a triangle's weight counts, for positive and for negative edges.
BALANCED = ("d1_1", "d2_1", "d2_4", "d3_4", "d4_1", "d4_4")
UNBALANCED = ("d1_2", "d1_3", "d2_3", "d3_2", "d3_3", "d4_2")


def _census(edges: DataFrame) -> DataFrame:
    """(src, dst, code, d0 ... d15): triad_census with the code that the edge has at its target (blocks.BITS)."""
    edges = kept(edges.select("src", "dst", F.signum("w").cast("int").alias("sign")))
    size = edges.agg(F.count("*").alias("n"), F.approx_count_distinct("src").alias("s"), F.approx_count_distinct("dst").alias("d")).first()
    dealt = B.dealt(B.entries(edges), F.col("node"), 2 * size.n, size.s + size.d, B.pack_adjacency(), B.ADJACENCY)
    bits = [(B.BITS[du, su], B.BITS[dv, sv]) for du, dv in TRIADS for su, sv in SIGNS]
    names = [f"d{k}" for k in range(len(bits))]
    found = B.pass_by(dealt, B.census(bits), "src long, dst long, code int, " + ", ".join(f"{n} long" for n in names))
    # edges without an endpoint have no third nodes
    none = edges.filter("src is null or dst is null").groupBy("src", "dst").agg(F.bit_or(F.when(F.col("sign") > 0, 4).when(F.col("sign") < 0, 8).otherwise(0)).alias("code"))
    return found.union(none.select("src", "dst", "code", *[F.lit(0).cast("long").alias(n) for n in names]))


def triad_census(edges: DataFrame) -> DataFrame:
    """(src, dst, d1_1 ... d4_4): for each edge, third nodes by orientation and signs.

    Neighbours of both endpoints meet within pairs of blocks of nodes, never as rows; edges without third nodes have zeros."""
    names = [f"d{i}_{j}" for i in range(1, len(TRIADS) + 1) for j in range(1, len(SIGNS) + 1)]
    return _census(edges).select("src", "dst", *[F.col(f"d{k}").alias(n) for k, n in enumerate(names)])


def triangle_weights(edges: DataFrame, census: DataFrame | None = None, signs: bool = False) -> DataFrame:
    """(src, dst, tri): balanced triads of positive edges; unbalanced ones of pairs that have a negative edge. signs: with w, 1 or -1."""
    total = lambda names: sum((F.col(c) for c in names[1:]), F.col(names[0]))
    if census is None:
        found = _census(edges)
        names = {f"d{k}": f"d{k // len(SIGNS) + 1}_{k % len(SIGNS) + 1}" for k in range(len(TRIADS) * len(SIGNS))}
        found = found.withColumnsRenamed(names).withColumn("w", F.when(F.col("code").bitwiseAND(B.BITS["in", -1]) > 0, -1.0).otherwise(1.0))
    else:
        found = census.join(edges.groupBy("src", "dst").agg(F.signum(F.min("w")).alias("w")), ["src", "dst"])
    tri = F.when(F.col("w") < 0, total(UNBALANCED)).otherwise(total(BALANCED)).alias("tri")
    return found.select("src", "dst", *(["w"] if signs else []), tri)


def motif_edges(edges: DataFrame) -> DataFrame:
    """(motif, src, dst): 38 lists - both directions, out and in for each sign (0..5), then positive and negative edges by triad.

    All rows of an edge are made from its census; a pair with edges both ways gives each row of both directions once."""
    has = lambda way: F.col("code").bitwiseAND(F.when(F.col("pos"), B.BITS[way, 1]).otherwise(B.BITS[way, -1])) > 0
    signed = _census(edges).withColumn("pos", F.explode(F.array(F.lit(True), F.lit(False)))).filter(has("in"))
    first, triad = F.when(F.col("pos"), 0).otherwise(3), F.when(F.col("pos"), 6).otherwise(22)
    row = lambda motif, src, dst, there: F.struct(motif.alias("motif"), F.col(src).alias("src"), F.col(dst).alias("dst"), there.alias("there"))
    rows = [row(first, "src", "dst", F.lit(True)), row(first, "dst", "src", ~has("out")), row(first + 1, "src", "dst", F.lit(True)), row(first + 2, "dst", "src", F.lit(True))]
    rows += [row(triad + k, "src", "dst", F.col(f"d{k}") > 0) for k in range(len(TRIADS) * len(SIGNS))]
    return signed.select(F.inline(F.array(*rows))).filter("there").drop("there")


def motif_attention(edges: DataFrame, nodes: DataFrame, x: DataFrame, gats: list[tuple], slope: float = 0.2) -> DataFrame:
    """(id, pos, val): layers.motif_attention over motif_edges, whose rows are not made: scores and sums within pairs of blocks of nodes."""
    edges = kept(edges.select("src", "dst", F.signum("w").cast("int").alias("sign")))
    vectors = x.groupBy("id").agg(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), F.col("val").cast("double").alias("val"))).alias("vec"))
    vectors = kept(vectors.join(nodes.select("id", F.lit(True).alias("loop")).distinct(), "id", "left").select("id", "vec", F.coalesce("loop", F.lit(False)).alias("loop")))
    ends = B.entries(edges).withColumns({"vec": F.lit(None).cast(vectors.schema["vec"].dataType), "loop": F.lit(None).cast("boolean")})
    named = vectors.select(F.col("id").alias("node"), F.lit(None).cast("long").alias("nbr"), F.lit(None).cast("int").alias("code"), "vec", "loop")
    dealt = B.dealt(ends.union(named), F.col("node"), 2 * edges.count(), vectors.count(), B.pack_adjacency(len(gats[0][0])), B.ADJACENCY)
    bits = [(B.BITS[du, su], B.BITS[dv, sv]) for du, dv in TRIADS for su, sv in SIGNS]
    return B.pass_by(dealt, B.attention(bits, gats, slope), "id long, pos int, val double")


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """(list, src, dst): pos_out, pos_in, neg_out, neg_in."""
    found = []
    for name, own in (("pos", edges.filter("w > 0")), ("neg", edges.filter("w < 0"))):
        found.append(own.select(F.lit(f"{name}_out").alias("list"), "src", "dst"))
        found.append(own.select(F.lit(f"{name}_in").alias("list"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    return _union(found)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def weak_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): smallest node id reachable over edges of either direction.

    Labels shrink to the neighbourhood's smallest, then jump to their label's label, until nothing moves."""
    both = kept(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    label = kept(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(label.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("c"))
        low = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("c", "component")).alias("component"))
        jump = low.join(low.select(F.col("id").alias("component"), F.col("component").alias("up")), "component").select("id", F.col("up").alias("component"))
        new = kept(jump)
        moved = new.join(label.withColumnRenamed("component", "old"), "id").filter("component <> old").limit(1).count()
        label = new
        if not moved:
            return label


def largest_component(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id) of the component with most nodes, of equal ones that with the smallest id."""
    label = weak_components(edges, nodes)
    best = label.groupBy("component").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("m"))
    return label.join(best.select((-F.col("m.c")).alias("component")), "component", "left_semi").select("id")


def peel(edges: DataFrame, nodes: DataFrame, lowest_degree: int = 2, rounds: int = 10) -> DataFrame:
    """(id): what is left after taking away nodes of a total degree below the least, at most `rounds` times.

    Where a round would leave nothing, the least falls by one and the peeling begins again."""
    while True:
        ids, e = kept(nodes.select("id")), edges
        size = before = ids.count()
        for _ in range(rounds):
            d = e.select(F.col("src").alias("id")).union(e.select("dst")).groupBy("id").agg(F.count("*").alias("d"))
            ids = kept(ids.join(d, "id", "left").filter(F.coalesce("d", F.lit(0)) >= lowest_degree).select("id"))
            e = induced(edges, ids)
            before, size = size, ids.count()
            if size in (0, before):
                break
        if size or lowest_degree <= 0:
            return ids
        lowest_degree -= 1


def extract_network(edges: DataFrame, nodes: DataFrame, lowest_degree: int = 2, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the largest component, peeled; ids as they were."""
    own = largest_component(edges, nodes)
    ids = peel(induced(edges, own), own, lowest_degree, rounds)
    return induced(edges, ids), nodes.join(ids, "id", "left_semi")


def spanning_forest(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) with src < dst: one tree for each component, by repeated hooking of components onto smaller neighbours.

    In each round, every component but the smallest of its neighbourhood hooks onto the smallest neighbour over its
    least edge; hooks point to smaller labels, so no cycle can form."""
    pairs = kept(edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    label = kept(nodes.select("id", F.col("id").alias("c")))
    forest = []
    while True:
        cross = pairs.join(label.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").filter("a <> b")
        hook = cross.select(F.greatest("a", "b").alias("from"), F.struct(F.least("a", "b").alias("to"), "src", "dst").alias("h")).groupBy("from").agg(F.min("h").alias("h"))
        hook = kept(hook.select("from", "h.to", "h.src", "h.dst"))
        if hook.isEmpty():
            break
        forest.append(hook.select("src", "dst"))
        up = hook.select(F.col("from").alias("c"), F.col("to"))
        while True:  # follow hooks to their ends
            far = kept(up.join(up.select(F.col("c").alias("to"), F.col("to").alias("far")), "to", "left").select("c", F.coalesce("far", "to").alias("to")))
            same = far.join(up.select("c", F.col("to").alias("was")), "c").filter("to <> was").isEmpty()
            up = far
            if same:
                break
        label = kept(label.join(up, "c", "left").select("id", F.coalesce("to", "c").alias("c")))
    return _union(forest) if forest else pairs.limit(0)
