"""Deterministic splits of nodes and links, link labels and negative samples.

Everything random is an order by hash, so a split is the same on any cluster. Quotas are exact: int(p * n), or for
the signs of a signed task the even-rounded share of p * n. Ranks are numbered in CELLS ranges of the hash with the
ranges' counts before them, so no split or class is sorted by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signet.functions import hash_key, uniform

from .edges import probe
from .iterate import kept
from .structure import spanning_forest

TASKS = ("existence", "direction", "three_class_digraph", "sign", "four_class_signed_digraph", "five_class_signed_digraph")


def _splits(nodes: DataFrame, splits: int) -> DataFrame:
    return nodes.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))


CELLS = 4096


def ranked(df: DataFrame, by: list[str], cell: Column, order: list) -> DataFrame:
    """df with r, each row's number from 1 within `by` in the given order, of which cell must be a coarser step.

    Two levels: numbers within a cell, and the sum of the counts of the cells before it."""
    rows = df.withColumn("__cell", cell)
    before = F.sum("__m").over(Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy(*by, "__cell").agg(F.count("*").alias("__m")).select(*by, "__cell", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*by, "__cell").orderBy(*order))
    return rows.withColumn("__r", within).join(sizes, [*by, "__cell"]).withColumn("r", F.col("__before") + F.col("__r")).drop("__cell", "__r", "__before")


def by_hash(df: DataFrame, by: list[str], key: Column, ties: list[str]) -> DataFrame:
    """df with r, each row's number from 1 within `by` in the order of a hexadecimal hash, then of ties."""
    return ranked(df, by, F.substring(key, 1, 3), [key, *ties])


def _rank(pool: DataFrame, by: list[str], tag: str) -> DataFrame:
    return by_hash(pool, by, hash_key(F.col("split"), tag, F.col("id")), ["id"])


def sample_per_class(labels: DataFrame, k: float, seed: int = 0, forbidden: DataFrame | None = None, force: DataFrame | None = None) -> DataFrame:
    """(id, y): k of each class where k is whole, else int(k * class size); only forced nodes, never forbidden ones.

    A share counts the whole class (or what of it is forced), not what is left of it. ValueError where a class has
    fewer nodes left than it must give."""
    pool = labels if force is None else labels.join(force.select("id"), "id", "left_semi")
    size = pool.groupBy("y").agg(F.count("*").alias("m"))
    if forbidden is not None:
        pool = pool.join(forbidden.select("id"), "id", "left_anti")
    want = F.lit(int(k)) if isinstance(k, int) else F.floor(F.col("m") * k)
    left = pool.groupBy("y").agg(F.count("*").alias("left"))
    if not size.join(left, "y", "left").filter(F.coalesce("left", F.lit(0)) < want).isEmpty():
        raise ValueError("a class has fewer nodes than are asked of it")
    return by_hash(pool, ["y"], hash_key(seed, "c", F.col("id")), ["id"]).join(size, "y").filter(F.col("r") <= want).select("id", "y")


def node_split(labels: DataFrame, splits: int = 10, train=None, val=None, test=None, seed_size=None, train_per_class=None, val_per_class=None, test_per_class=None, seed_per_class=None) -> DataFrame:
    """(split, id, role, seed): train, then seeds inside train, then val and test from the rest; no test size: all the rest.

    Whole sizes are counts; shares per class are of the whole class, shares without classes of what is left.
    ValueError where both kinds of a size are given, or none for train."""
    for a, b in ((train, train_per_class), (val, val_per_class), (test, test_per_class), (seed_size, seed_per_class)):
        if a is not None and b is not None:
            raise ValueError("give a size or a size per class, not both")
    if train is None and train_per_class is None:
        raise ValueError("a training size is needed")
    every = _splits(labels.select("id", "y"), splits)
    sizes = every.groupBy("split", "y").agg(F.count("*").alias("whole"))

    def take(pool: DataFrame, role: str, size, per_class) -> DataFrame:
        if per_class is not None:
            want = F.lit(per_class) if isinstance(per_class, int) else F.floor(F.col("whole") * per_class)
            return _rank(pool, ["split", "y"], role).join(sizes, ["split", "y"]).filter(F.col("r") <= want).select("split", "id", "y")
        left = pool.groupBy("split").agg(F.count("*").alias("left"))
        want = F.lit(size) if isinstance(size, int) else F.floor(F.col("left") * size)
        return _rank(pool, ["split"], role).join(left, "split").filter(F.col("r") <= want).select("split", "id", "y")

    rest, parts = every, []
    chosen = take(rest, "train", train, train_per_class)
    marks = chosen.limit(0) if seed_size is None and seed_per_class is None else take(chosen, "seed", seed_size, seed_per_class)
    parts.append(chosen.withColumn("role", F.lit("train")))
    rest = rest.join(chosen.select("split", "id"), ["split", "id"], "left_anti")
    if val is not None or val_per_class is not None:
        chosen = take(rest, "val", val, val_per_class)
        parts.append(chosen.withColumn("role", F.lit("val")))
        rest = rest.join(chosen.select("split", "id"), ["split", "id"], "left_anti")
    chosen = rest if test is None and test_per_class is None else take(rest, "test", test, test_per_class)
    parts.append(chosen.withColumn("role", F.lit("test")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(marks.select("split", "id", F.lit(True).alias("seed")), ["split", "id"], "left").select("split", "id", "role", F.coalesce("seed", F.lit(False)).alias("seed"))


def negative_samples(edges: DataFrame, n: int, count: int, seed: int = 0, tries: int = 4) -> DataFrame:
    """(src, dst): `count` distinct pairs of 0..n-1 that are in the edges in neither direction, no loops; all such pairs where fewer exist.

    Candidates are drawn by number, so only count * tries of them exist, whatever n is. They fall short only where most
    pairs are linked or asked for, so listing all n * n pairs for the rest is work in proportion to edges and count."""
    drawn = edges.sparkSession.range(count * tries).select((F.floor(uniform(seed, "u", F.col("id")) * n)).alias("src"), (F.floor(uniform(seed, "v", F.col("id")) * n)).alias("dst"), "id")
    drawn = drawn.filter("src <> dst").groupBy("src", "dst").agg(F.min("id").alias("at"))
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    found = ranked(drawn.join(both, ["src", "dst"], "left_anti"), [], F.floor(F.col("at") * (CELLS / max(1, count * tries))), ["at"])
    found = found.filter(F.col("r") <= count).select("src", "dst")
    short = count - found.count()
    if short <= 0:
        return found
    found = kept(found)
    every = edges.sparkSession.range(n * n).select(F.floor(F.col("id") / n).alias("src"), (F.col("id") % n).alias("dst")).filter("src <> dst")
    rest = every.join(both, ["src", "dst"], "left_anti").join(found, ["src", "dst"], "left_anti")
    rest = by_hash(rest, [], hash_key(seed, "w", F.col("src"), F.col("dst")), ["src", "dst"])
    return found.union(rest.filter(F.col("r") <= short).select("src", "dst"))


def structured_negatives(edges: DataFrame, n: int, seed: int = 0, tries: int = 6) -> DataFrame:
    """(src, dst, neg): for each edge the first of `tries` drawn nodes of 0..n-1 that the source has no edge to.

    Where all draws hit links, one of the source's free nodes is chosen by its rank among them; only edges whose source
    is linked to all nodes go."""
    drawn = edges.select("src", "dst", F.posexplode(F.array(*[F.floor(uniform(seed, F.col("src"), F.col("dst"), t) * n) for t in range(tries)])).alias("t", "neg"))
    free = drawn.join(edges.select("src", F.col("dst").alias("neg")), ["src", "neg"], "left_anti")
    met = free.groupBy("src", "dst").agg(F.min(F.struct("t", "neg")).alias("m")).select("src", "dst", F.col("m.neg").alias("neg"))
    unmet = edges.select("src", "dst").distinct().join(met, ["src", "dst"], "left_anti")
    # free nodes below the i-th link (from 0) are link - i; the r-th free node is r + the number of links with no more than r free nodes below
    links = edges.filter(F.col("dst").between(0, n - 1)).select("src", F.col("dst").alias("link")).distinct().join(unmet.select("src").distinct(), "src", "left_semi")
    links = links.withColumn("at", F.col("link") - F.row_number().over(Window.partitionBy("src").orderBy("link")) + 1)
    room = links.groupBy("src").agg((F.lit(n) - F.count("*")).alias("room"))
    rank = F.floor(uniform(seed, "rest", F.col("src"), F.col("dst")) * F.col("room"))
    asked = unmet.join(room, "src").filter("room > 0").select("src", "dst", rank.alias("at"), F.lit(1).alias("asks"))
    line = links.select("src", F.lit(None).cast("long").alias("dst"), "at", F.lit(0).alias("asks")).union(asked)
    below = F.sum(1 - F.col("asks")).over(Window.partitionBy("src").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
    return met.union(line.withColumn("below", below).filter("asks = 1").select("src", "dst", (F.col("at") + F.col("below")).alias("neg")))


def link_labels(pairs: DataFrame, edges: DataFrame, task: str, keys: tuple[str, ...] = (), weights: bool = False) -> DataFrame:
    """(src, dst, label) of pairs(src, dst) against an adjacency; columns named in keys stay, and pairs are distinct within them.
    With weights also weight: that of the link a label stands for (a reversal has its forward pair's), 0 where there is none.

    Directed tasks leave out pairs that are linked in both directions, and pairs linked only backwards: a forward pair
    is class 0 and its reversal class 1, a pair without any link class 2. Signed directed tasks: 0 and 1 for forward
    positive and negative, 2 and 3 for their reversals, 4 for no link. sign: 0 below 0, 1 above 0, 2 none. existence: 0
    linked, 1 not. Tasks of fewer classes leave out the higher ones."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task}")
    p = probe(pairs.select(*keys, "src", "dst").distinct(), edges)
    forward, absent = (F.col("w") != 0) & (F.col("w_rev") == 0), (F.col("w") == 0) & (F.col("w_rev") == 0)
    flip = lambda d: d.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in d.columns])
    labelled = lambda d, label: d.select(*keys, "src", "dst", label.alias("label"), *([F.col("w").alias("weight")] if weights else []))
    if task == "existence":
        return labelled(p, F.when(F.col("w") != 0, 0).otherwise(1))
    if task == "sign":
        return labelled(p.filter("w <> 0"), F.when(F.col("w") < 0, 0).otherwise(1))
    none = p.filter(absent)
    one = p.filter(forward)
    if task in ("direction", "three_class_digraph"):
        first = labelled(one, F.lit(0))
        out = first.unionByName(flip(first.withColumn("label", F.lit(1))))
        return out if task == "direction" else out.unionByName(labelled(none, F.lit(2)))
    first = labelled(one, F.when(F.col("w") > 0, 0).otherwise(1))
    out = first.unionByName(flip(first.withColumn("label", F.col("label") + 2)))
    return out if task.startswith("four") else out.unionByName(labelled(none, F.lit(4)))


def mutual_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): the pairs that are linked in both directions, which directed tasks leave out."""
    return probe(pairs.select("src", "dst").distinct(), edges).filter("w <> 0 and w_rev <> 0").select("src", "dst")


def link_split(edges: DataFrame, nodes: DataFrame, n: int, task: str, splits: int = 2, prob_test: float = 0.15, prob_val: float = 0.05, seed: int = 0, maintain_connect: bool = True, ratio: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(links, observed): links (split, part, src, dst, label) and the graph (split, src, dst, w) that training may see.

    Edges are shuffled by hash in each split; int(prob * edges) go to test and to val, in signed tasks prob * edges * the
    sign's share of them, rounded half to even, of each sign. int(ratio * edges) + 1 in the order of an absent class,
    a sign or all edges are used at most. With maintain_connect a spanning forest stays in train, both ways; ValueError
    where fewer edges are left than test and val take. Where the task has a class of absent links, as many negative pairs
    as edges are split the same way. Observed are the linked train pairs and mutual train edges."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task}")
    if maintain_connect and ratio != 1:
        raise ValueError("connectivity can only be kept with ratio 1")
    if not 0 < ratio <= 1 or ratio <= prob_test + prob_val:
        raise ValueError("ratio must be in (0, 1] and above the shares of val and test")
    signed = task in TASKS[3:]
    every = edges.select("src", "dst", F.when((F.col("w") > 0) | F.lit(not signed), 1).otherwise(0).alias("kind"))
    total, positive = edges.agg(F.count("*"), F.count_if(F.col("w") > 0)).first()
    share = {1: positive / total, 0: 1 - positive / total} if signed and total else {}
    plain = int(prob_test * total), int(prob_val * total)
    quotas = {kind: (round(prob_test * total * part), round(prob_val * total * part)) for kind, part in share.items()}  # half to even
    most = int(ratio * total) + 1
    if maintain_connect:
        tree = spanning_forest(edges, nodes)
        tree = tree.union(tree.select("dst", "src"))
        loose = every.join(tree, ["src", "dst"], "left_anti")
        if loose.count() < sum(plain):
            raise ValueError("not enough edges outside the forest for test and val: use smaller shares")
    else:
        tree, loose = None, every

    def part(test: int, val: int) -> Column:
        return F.when(F.col("r") <= test, "test").when(F.col("r") <= test + val, "val").when(F.col("r") <= most, "train")

    def deal(rows: DataFrame, by: list[str], *tag) -> DataFrame:
        spread = rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
        return by_hash(spread, ["split", *by], hash_key(seed, *tag, F.col("split"), F.col("src"), F.col("dst")), ["src", "dst"])

    named = part(*plain)
    for kind, quota in quotas.items():
        named = F.when(F.col("kind") == kind, part(*quota)).otherwise(named)
    dealt = deal(loose, ["kind"]).withColumn("part", named).filter("part is not null").select("split", "part", "src", "dst")
    if tree is not None:
        dealt = dealt.union(tree.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).select("split", F.lit("train").alias("part"), "src", "dst"))
    if task in ("existence", "three_class_digraph", "five_class_signed_digraph"):
        extra = deal(negative_samples(edges, n, total, seed), [], "n")
        extra = extra.withColumn("part", part(*plain)).filter("part is not null").select("split", "part", "src", "dst")
        dealt = dealt.union(extra)
    links = link_labels(dealt, edges, task, ("split", "part")).withColumn("label", F.col("label").cast("int"))
    train = dealt.filter("part = 'train'").select("split", "src", "dst").distinct()
    observed = train.join(edges.select("src", "dst", "w"), ["src", "dst"]).select("split", "src", "dst", "w")
    return links, observed
