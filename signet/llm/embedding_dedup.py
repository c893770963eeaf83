"""Near-duplicate vectors by collision-counting projections.

Every unit vector is projected onto M random Gaussian lines. For vectors at distance d a projection's
difference is normal with deviation d, whatever the data, so a pair at the limit falls into the query-centred
window of half width w on each line with one known chance: the number of collisions of such a pair is
binomial, and the least count that keeps RECALL of them is its quantile. Lines are sorted; each vector's
window is a slice of the sorted line; collisions are counted for each pair, and pairs that pass the count are
verified by their cosine in double precision. So no pair below the limit is linked.

Equal vectors of one label are one representative with a multiplicity. The representatives of a label are
dealt, in the order of their place on the first line (scaled to length 1), into blocks of BLOCK; two blocks meet
only if their intervals on that line come within the distance that the limit allows (every linked pair does,
exactly). A task holds two blocks. It returns link counts for each vector and the edges of a spanning forest, never
all pairs. For vectors without structure in many dimensions the windows hold a share of a label that does not
depend on its size, so the work in a label is the square of its distinct vectors, spread over its pairs of blocks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute is used below
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, components

COSINE, RECALL = 0.93, 0.9995
LINES, WIDTH, SEED = 32, 1.0, 7
BLOCK = 1024


def window_and_count(limit: float = COSINE, lines: int = LINES, recall: float = RECALL, width: float = WIDTH) -> tuple[float, int]:
    """Half width of the windows (in deviations of a pair at the limit) and the least number of collisions."""
    d = math.sqrt(2 * (1 - limit))
    p = math.erf(width / math.sqrt(2))
    tail, count = 0.0, 0
    while tail + math.comb(lines, count) * p**count * (1 - p) ** (lines - count) <= 1 - recall:
        tail += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        count += 1
    return width * d, count


def lines_of(dim: int, lines: int = LINES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, lines))


def collisions(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """counts[i, j]: on how many lines b's point j lies in the window around a's point i."""
    counts = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        line = b[order, k]
        lo, hi = np.searchsorted(line, a[:, k] - half, "left"), np.searchsorted(line, a[:, k] + half, "right")
        # the windows as marks on the sorted line, summed along it and put back in b's order
        inside = np.zeros((len(a), len(b) + 1), np.int8)
        rows = np.arange(len(a))
        np.add.at(inside, (rows, lo), 1)
        np.add.at(inside, (rows, hi), -1)
        counts[:, order] += np.cumsum(inside[:, :-1], axis=1, dtype=np.int8).view(np.uint8)
    return counts


def _pairs(limit: float, lines: int, recall: float):
    half, least = window_and_count(limit, lines, recall)

    def link(key, left, right):
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        same = key[1].as_py() == key[2].as_py()
        get = lambda t: (np.array(t.column(3).to_pylist(), np.int64), np.stack([np.frombuffer(x) for x in t.column(5).to_pylist()]), np.array(t.column(4).to_pylist(), np.int64))
        (ia, a, na), (ib, b, nb) = get(left), get(right)
        line = lines_of(a.shape[1], lines)
        counts = collisions(a @ line, b @ line, half)
        if same:
            counts[np.tril_indices(len(a))] = 0
        i, j = np.nonzero(counts >= least)
        ok = np.empty(len(i), bool)
        for lo in range(0, len(i), 65536):
            ok[lo : lo + 65536] = np.einsum("ij,ij->i", a[i[lo : lo + 65536]], b[j[lo : lo + 65536]]) >= limit
        i, j = i[ok], j[ok]
        links_a, links_b = np.bincount(i, weights=nb[j], minlength=len(a)), np.bincount(j, weights=na[i], minlength=len(b))
        # a spanning forest of the block's links
        parent = list(range(len(a) + (0 if same else len(b))))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        ids, edges = ia if same else np.concatenate([ia, ib]), []
        for x, y in zip(i.tolist(), (j + (0 if same else len(a))).tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                parent[q] = p
                edges.append((int(ids[x]), int(ids[y]), 0))
        rows = edges + [(int(r), int(r), int(n)) for r, n in zip(ia, links_a, strict=True) if n] + [(int(r), int(r), int(n)) for r, n in zip(ib, links_b, strict=True) if n]
        return pa.table({k: pa.array([r[c] for r in rows], pa.int64()) for c, k in enumerate(("a", "b", "links"))})

    return link


def units(values: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None where a list is null, empty or zero, or holds null or non-finite numbers.

    Scaled by the largest component first, so that no square overflows or vanishes."""
    values = values.cast(pa.list_(pa.float64()))
    flat = values.flatten()
    numbers = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pa.compute.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False))
    out: list[np.ndarray | None] = []
    for a, b in zip(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64), strict=True):
        v = numbers[a:b]
        top = np.abs(v).max() if b > a else 0.0
        if not (np.isfinite(top) and top > 0):
            out.append(None)
            continue
        v = v / top
        v = v / np.sqrt((v * v).sum())
        out.append(v + 0.0)  # a negative zero equals zero
    return out


def _prepare(batches):
    """(id, node, key, group, unit, place): node and key are 64 and 128 bits of a hash of label and unit vector."""
    names = ["id", "node", "key", "group", "unit", "place"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.float64()]
    first: dict[int, np.ndarray] = {}
    for batch in batches:
        ids, labels = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "label"))
        rows = []
        for i, label, v in zip(ids, labels, units(batch.column(batch.schema.get_field_index("v"))), strict=True):
            if v is None or label is None or i is None:
                rows.append((i, None, None, None, None, None))
                continue
            if len(v) not in first:
                line = lines_of(len(v), 1)[:, 0]
                first[len(v)] = line / np.linalg.norm(line)
            group, raw = f"{len(v)}|{label}", v.tobytes()
            h = hashlib.blake2b(group.encode() + b"\0" + raw, digest_size=16).digest()
            rows.append((i, int.from_bytes(h[:8], "little", signed=True), h, group, raw, float(v @ first[len(v)])))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", limit: float = COSINE, lines: int = LINES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of df.

    Vectors of any width are compared where labels and dimensions are equal. Null labels, null or empty vectors, zero
    vectors and such with null or non-finite components link with nothing. Equal vectors link with each
    other. Ids are integers, one a row; a repeated id with an equal vector counts as one more equal vector, with
    another vector as a row of its own; a null id has no links and a null component. An empty table gives none.
    """
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").cast("string").alias("label"))
    every = Table(base.mapInArrow(_prepare, "id long, node long, key binary, group string, unit binary, place double"), "units").df
    member = every.filter("key is not null").select("id", "key")
    reps = every.filter("key is not null").groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("node").alias("rep"), F.first("group").alias("group"), F.first("unit").alias("unit"), F.first("place").alias("place"))
    reps = Table(reps, "vectors").df
    # blocks: fine cells of the line are counted, and cells of a label are joined until a block is full
    cell = F.floor(F.col("place") * 4096).cast("int")
    cells = reps.withColumn("cell", cell).groupBy("group", "cell").agg(F.count("*").alias("m"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    upto = Window.partitionBy("group").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("m").over(upto), F.lit(0)))
    placed = reps.withColumn("cell", cell).join(cells.select("group", "cell", "before"), ["group", "cell"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("group", "cell").orderBy("place", "rep")) - 1
    blocked = Table(placed.withColumn("block", F.floor(rank / block).cast("long")).select("group", "block", "rep", "n", "unit", "place"), "blocks").df
    extent = blocked.groupBy("group", "block").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    reach = math.sqrt(2 * (1 - limit)) + 1e-9
    x, y = extent.alias("x"), extent.alias("y")
    near = (F.col("x.group") == F.col("y.group")) & (F.col("x.block") <= F.col("y.block")) & (F.col("y.lo") - F.col("x.hi") <= reach)
    meets = x.join(y, near).select(F.col("x.group").alias("group"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    columns = ("group", "i", "j", "rep", "n", "unit")
    left = meets.join(blocked.withColumnRenamed("block", "i"), ["group", "i"]).select(*columns)
    right = meets.join(blocked.withColumnRenamed("block", "j"), ["group", "j"]).select(*[F.col(c).alias(f"{c}_") for c in columns])
    found = left.groupBy("group", "i", "j").cogroup(right.groupBy("group_", "i_", "j_")).applyInArrow(_pairs(limit, lines, recall), "a long, b long, links long")
    found = Table(found, "links").df
    links = found.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("a <> b")).select(F.col("node").alias("rep"), "root")
    known = reps.select("key", "rep", "low", "n").join(links, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    known = Table(known, "known").df
    low = known.groupBy("root").agg(F.min("low").alias("component_id"))
    of = known.join(low, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = member.join(of, "key").select("id", "n_links", "component_id")
    alone = every.filter("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("id") == F.col("component_id"))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return near_duplicates(rows).withColumnRenamed("id", "vec_id")


def op9_sql() -> str:
    """Independent SQL over all pairs of a label."""
    return f"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
good as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v
  where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
u as (select vec_id, label, list_transform(e, lambda x: x / norm) as e from good where norm > 0),
links as materialized (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id
  and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) >= {COSINE}),
reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from reach group by a),
n as (select a as vec_id, count(*) as n from links group by a)
select v.vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, v.vec_id = component_id as kept
from v left join n using (vec_id) join c using (vec_id)
"""
