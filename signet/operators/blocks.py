"""Work on pairs of blocks of nodes.

Edges are dealt into blocks by one endpoint, each block one row of arrays. A task holds one block while all blocks pass by it, so
what is written is each block once; nothing is written for pairs of edges that meet at a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import kept

#: A block has about this many entries (two an edge) and nodes at most; a node is never split.
ENTRIES, NODES = 1 << 21, 1 << 15
#: Small graphs get up to PARTS blocks of at least LEAST entries, so that all cores have work.
PARTS, LEAST = 16, 1 << 16
#: Pairs of entries that a task compares at a time, and rows that it gives back at a time.
CHUNK, ROWS = 1 << 20, 1 << 16

#: Bits of an entry's code by direction, as seen from the entry's node, and sign; then one for each direction of any sign.
BITS = {("out", 1): 1, ("out", -1): 2, ("in", 1): 4, ("in", -1): 8}
OUT, IN = 16, 32


def entries(edges: DataFrame) -> DataFrame:
    """(node, nbr, code) of edges(src, dst, sign), from both ends; rows without an endpoint are left out."""
    code = lambda way, bit: F.lit(bit) + F.when(F.col("sign") == 1, BITS[way, 1]).when(F.col("sign") == -1, BITS[way, -1]).otherwise(0)
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr"), code("out", OUT).alias("code")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr"), code("in", IN).alias("code")),
    )
    return edges.filter("src is not null and dst is not null").select(F.inline(ends))


def dealt(rows: DataFrame, node: Column, entries: int, nodes: int, pack, schema: str) -> DataFrame:
    """One row a block: pack makes it from the rows of the block's nodes."""
    n = max(1, -(-entries // ENTRIES), -(-nodes // NODES), min(PARTS, entries // LEAST))
    parts = rows.withColumn("block", F.pmod(F.xxhash64(node), F.lit(n)).cast("int")).repartitionById(n, "block")
    return kept(parts.mapInArrow(pack, schema))


def pass_by(blocks: DataFrame, kernel, schema: str) -> DataFrame:
    """kernel over the rows of each task: a block that passes by (columns with an underscore before) and the task's own.

    The task's block is the buffered side of a product of partitions; the other side is read block after block."""
    passing = blocks.select(*[F.col(c).alias(f"_{c}") for c in blocks.columns]).coalesce(1)
    return passing.hint("shuffle_replicate_nl").crossJoin(blocks).mapInArrow(kernel, schema)


def array(scalar, dtype: str):
    import numpy as np

    return np.frombuffer(scalar.as_buffer(), np.dtype(dtype))


def binary(array):
    import pyarrow as pa

    return pa.array([array.tobytes()], pa.binary())


def match(x, y):
    """For each of x its place in the ascending y, or -1."""
    import numpy as np

    if not len(y):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return np.where(y[at] == x, at, -1)


def spread(start, rows):
    """(which of rows, entry) for all entries of the rows; entries of row r are start[r] to start[r + 1]."""
    import numpy as np

    n = start[rows + 1] - start[rows]
    which = np.repeat(np.arange(len(rows)), n)
    return which, np.arange(len(which)) + np.repeat(start[rows] - (np.cumsum(n) - n), n)


def slices(sizes, most: int, rows: int | None = None):
    """Ranges of consecutive places whose sizes add up to about `most`, of at least one place each and of `rows` at most."""
    import numpy as np

    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        end = end if rows is None else min(end, at + rows)
        yield at, end
        at = end


ADJACENCY = "block int, nodes binary, start binary, ids binary, at binary, code binary, vec binary, has binary"


def pack_adjacency(width: int = 0):
    """Rows (block, node, nbr, code[, vec, loop]) -> ADJACENCY: nodes ascending, entries by node and neighbour with their codes
    together, neighbours as places in ids. Rows without nbr bring a node's vector; has: 1 for such nodes, 3 where they have a loop."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        block, found, named, vectors, has = None, [], [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            block = b.column("block")[0].as_py()
            own = b.column("nbr").is_null() if width else None
            if own is not None:
                v = b.filter(own)
                named.append(v.column("node").to_numpy(zero_copy_only=False))
                vectors += v.column("vec").to_pylist()
                has.append(1 + 2 * v.column("loop").to_numpy(zero_copy_only=False).astype("uint8"))
                b = b.filter(b.column("nbr").is_valid())
            found.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "nbr", "code")])
        if block is None:
            return
        node, nbr, code = (np.concatenate(c) for c in zip(*found, strict=True))
        found.clear()
        order = np.lexsort((nbr, node))
        node, nbr, code = node[order], nbr[order], code[order].astype(np.uint8)
        if len(node):
            first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])])
            node, nbr, code = node[first], nbr[first], np.bitwise_or.reduceat(code, first)
        names = np.concatenate(named) if named else np.zeros(0, np.int64)
        nodes = np.unique(np.r_[node, names].astype(np.int64))
        ids, at = np.unique(nbr.astype(np.int64), return_inverse=True)
        start = np.searchsorted(node, nodes).astype(np.int64)
        vec, kind = np.zeros((len(nodes), width)), np.zeros(len(nodes), np.uint8)
        if width and len(names):
            place = np.searchsorted(nodes, names)
            for p, entries in zip(place, vectors, strict=True):
                for e in entries:
                    vec[p, e["pos"]] = e["val"]
            kind[place] = np.concatenate(has)
        columns = [nodes, np.r_[start, len(node)].astype(np.int64), ids, at.astype(np.int32), code, vec, kind]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[binary(c) for c in columns]], ["block", "nodes", "start", "ids", "at", "code", "vec", "has"])

    return run


class Adjacency:
    """A block's arrays, and what is made of them once."""

    def __init__(self, batch, k: int, prefix: str = "", width: int = 0):
        import numpy as np

        # a block that stays must not hold the batch that it came with
        get = lambda name, dtype: array(batch.column(prefix + name)[k], dtype) if prefix else array(batch.column(name)[k], dtype).copy()
        self.block = batch.column(prefix + "block")[k].as_py()
        self.nodes, self.start, self.ids, self.at, self.code = get("nodes", "i8"), get("start", "i8"), get("ids", "i8"), get("at", "i4"), get("code", "u1")
        self.vec, self.has = get("vec", "f8").reshape(len(self.nodes), width), get("has", "u1")
        self.degree = np.diff(self.start)
        self._row = self._key = None

    @property
    def row(self):
        """The node of each entry."""
        import numpy as np

        if self._row is None:
            self._row = np.repeat(np.arange(len(self.nodes)), self.degree)
        return self._row

    @property
    def key(self):
        """Node and neighbour of each entry as one ascending number."""
        if self._key is None:
            self._key = self.row * max(1, len(self.ids)) + self.at
        return self._key


def _meet(x, at_x, y, at_y, x_to_y):
    """(pair, code at x, code at y) for the common neighbours of the pairs of nodes at_x of x and at_y of y."""
    import numpy as np

    pair, entry = spread(x.start, at_x)
    there = x_to_y[x.at[entry]]
    near = there >= 0
    pair, entry, there = pair[near], entry[near], there[near]
    key = at_y[pair] * max(1, len(y.ids)) + there
    place = np.minimum(np.searchsorted(y.key, key), max(0, len(y.key) - 1))
    hit = y.key[place] == key
    return pair[hit], x.code[entry[hit]], y.code[place[hit]]


def third_nodes(a, b, u, v, bits):
    """Ranges of the pairs (u of a, v of b) and, for each pair of the range, how many third nodes have both bits, by place in `bits`.

    The neighbours of the node with fewer are looked up among the other's."""
    import numpy as np

    a_to_b, b_to_a = match(a.ids, b.ids), match(b.ids, a.ids)
    for lo, hi in slices(np.minimum(a.degree[u], b.degree[v]), CHUNK, ROWS):
        uu, vv = u[lo:hi], v[lo:hi]
        counts = np.zeros((hi - lo, len(bits)), np.int64)
        few = a.degree[uu] <= b.degree[vv]
        for own, swap in ((np.flatnonzero(few), False), (np.flatnonzero(~few), True)):
            if not len(own):
                continue
            if swap:
                pair, cv, cu = _meet(b, vv[own], a, uu[own], b_to_a)
            else:
                pair, cu, cv = _meet(a, uu[own], b, vv[own], a_to_b)
            for k, (bu, bv) in enumerate(bits):
                both = ((cu & bu) > 0) & ((cv & bv) > 0)
                counts[own, k] += np.bincount(pair[both], minlength=len(own))
        yield lo, hi, counts


def into(a, b):
    """(node of a, node of b, code) for the entries of b's nodes with neighbours in a, by node of b."""
    import numpy as np

    other = match(b.ids, a.nodes)[b.at]
    found = np.flatnonzero(other >= 0)
    return other[found], b.row[found], b.code[found]


def census(bits):
    """Blocks of ADJACENCY -> (src, dst, code, d0 ...) for each edge into the task's block."""

    def run(batches):
        import pyarrow as pa

        own = {}
        names = ["src", "dst", "code", *[f"d{k}" for k in range(len(bits))]]
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column("block")[k].as_py()
                if block not in own:
                    own[block] = Adjacency(batch, k)
                a, b = Adjacency(batch, k, "_"), own[block]
                u, v, code = into(a, b)
                edge = (code & IN) > 0
                u, v, code = u[edge], v[edge], code[edge]
                for lo, hi, counts in third_nodes(a, b, u, v, bits):
                    columns = [a.nodes[u[lo:hi]], b.nodes[v[lo:hi]], code[lo:hi].astype("int32"), *counts.T.copy()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


WEIGHTS = "block int, nodes binary, " + ", ".join(f"{way}_{name} binary" for way in ("out", "in") for name in ("start", "ids", "at", "w"))


def pack_weights(batches):
    """Rows (block, node, nbr, out, w) -> WEIGHTS: nodes ascending and, for each direction, entries by node and neighbour, neighbours as places in ids."""
    import numpy as np
    import pyarrow as pa

    block, found = None, []
    for b in batches:
        if b.num_rows:
            block = b.column("block")[0].as_py()
            found.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "nbr", "out", "w")])
    if block is None:
        return
    node, nbr, out, w = (np.concatenate(c) for c in zip(*found, strict=True))
    found.clear()
    nodes = np.unique(node)
    columns = [nodes]
    for way in (True, False):
        own = np.flatnonzero(out == way)
        own = own[np.lexsort((nbr[own], node[own]))]
        ids, at = np.unique(nbr[own], return_inverse=True)
        start = np.r_[np.searchsorted(node[own], nodes), len(own)]
        columns += [start.astype(np.int64), ids, at.astype(np.int32), w[own].astype(np.float64)]
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[binary(c) for c in columns]], [c.split()[0] for c in WEIGHTS.split(", ")])


class _Side:
    """One direction of a block: entries by node or, turned, by neighbour."""

    def __init__(self, batch, k: int, name: str):
        get = lambda part, dtype: array(batch.column(f"{name}_{part}")[k], dtype)
        self.start, self.ids, self.at, self.w = get("start", "i8"), get("ids", "i8"), get("at", "i4"), get("w", "f8")

    def turned(self):
        """By neighbour: start over ids, the node in at; arrays of its own."""
        import numpy as np

        node = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start)).astype(np.int32)
        order = np.argsort(self.at, kind="stable")
        self.start = np.r_[0, np.cumsum(np.bincount(self.at, minlength=len(self.ids)))]
        self.ids, self.at, self.w = self.ids.copy(), node[order], self.w[order]
        return self


def _product(x, y, x_to_y, lo: int, hi: int, width: int):
    """(key, value), keys ascending: for nodes lo to hi of x and all nodes of the turned y, sums over shared neighbours of products of weights."""
    import numpy as np

    first, last = x.start[lo], x.start[hi]
    node = np.repeat(np.arange(hi - lo), np.diff(x.start[lo : hi + 1]))
    there = x_to_y[x.at[first:last]]
    near = np.flatnonzero(there >= 0)
    which, entry = spread(y.start, there[near])
    key = node[near][which] * width + y.at[entry]
    value = x.w[first:last][near][which] * y.w[entry]
    if (hi - lo) * width <= 4 * len(key):  # dense: sums by place
        there = np.flatnonzero(np.bincount(key, minlength=(hi - lo) * width))
        return there, np.bincount(key, value, (hi - lo) * width)[there]
    order = np.argsort(key)
    key, value = key[order], value[order]
    if not len(key):
        return key, value
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[at], np.add.reduceat(value, at)


def _both_products(a, b, width: int):
    """(node of the passing block, node of the task's, value): half the sum of the products by in- and by out-neighbours, where both have a place."""
    import numpy as np

    maps = [match(x.ids, y.ids) for x, y in zip(a, b, strict=True)]
    work = 0
    for x, y, to in zip(a, b, maps, strict=True):
        n = np.r_[np.diff(y.start), 0][to[x.at]]  # -1, no place, is the 0 at the end
        total = np.r_[0, np.cumsum(n)]
        work = work + total[x.start[1:]] - total[x.start[:-1]]
    for lo, hi in slices(work, CHUNK):
        (k1, v1), (k2, v2) = (_product(x, y, to, lo, hi, width) for x, y, to in zip(a, b, maps, strict=True))
        at = match(k1, k2)
        both = np.flatnonzero(at >= 0)
        if len(both):
            node, other = np.divmod(k1[both], width)
            yield lo + node, other, (v1[both] + v2[at[both]]) / 2


def second_order(scaled: bool):
    """Blocks of WEIGHTS -> (src, dst, w) with scaled, which needs a column r of factors for the nodes; else (block, r): the sums
    of each of the block's nodes to the power -1/2. The product is symmetric, so sums over the passing nodes are the rows'."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = {}
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column("block")[k].as_py()
                if block not in own:
                    nodes = array(batch.column("nodes")[k], "i8").copy()
                    own[block] = nodes, [_Side(batch, k, way).turned() for way in ("out", "in")], np.zeros(len(nodes)), array(batch.column("r")[k], "f8").copy() if scaled else None
                nodes, b, total, r = own[block]
                passing = array(batch.column("_nodes")[k], "i8")
                factor = array(batch.column("_r")[k], "f8") if scaled else None
                for u, v, w in _both_products([_Side(batch, k, f"_{way}") for way in ("out", "in")], b, len(nodes)):
                    if not scaled:
                        total += np.bincount(v, w, len(nodes))
                        continue
                    w = factor[u] * w * r[v]
                    for at in range(0, len(u), ROWS):
                        part = slice(at, at + ROWS)
                        yield pa.RecordBatch.from_arrays([pa.array(passing[u[part]]), pa.array(nodes[v[part]]), pa.array(w[part])], ["src", "dst", "w"])
        if not scaled:
            for block, (_, _, total, _) in own.items():
                with np.errstate(divide="ignore"):
                    root = np.where(total == 0, 0.0, total**-0.5)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), binary(root)], ["block", "r"])

    return run


def attention(bits, gats, slope: float):
    """Blocks of ADJACENCY with vectors -> (id, pos, val): graph attention over each of the 38 motif lists, outputs side by side.

    The softmax of a target is kept as its greatest score so far and sums relative to it, while its sources pass by; a node with a
    loop starts with itself. A node without a vector takes no part."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        weight, to_src, to_dst = (np.array([g[k] for g in gats], float) for k in range(3))  # motif x width x out, motif x out
        width, out, m = weight.shape[1], weight.shape[2], len(gats)

        def load(batch, k, prefix=""):
            a = Adjacency(batch, k, prefix, width)
            a.h = np.einsum("nw,mwo->nmo", a.vec, weight)
            a.ss, a.sd = (a.h * to_src).sum(axis=2), (a.h * to_dst).sum(axis=2)
            return a

        leaky = lambda s: np.where(s >= 0, s, s * slope)

        def add(state, a, b, motif, u, v):
            if not len(u):
                return
            top, total, value = state
            s = leaky(a.ss[u, motif] + b.sd[v, motif])
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            rows = v[first]
            new = np.maximum(top[rows, motif], np.maximum.reduceat(s, first))
            old = np.exp(top[rows, motif] - new)
            e = np.exp(s - np.repeat(new, np.diff(np.r_[first, len(v)])))
            top[rows, motif] = new
            total[rows, motif] = total[rows, motif] * old + np.add.reduceat(e, first)
            value[rows, motif] = value[rows, motif] * old[:, None] + np.add.reduceat(e[:, None] * a.h[u, motif], first, axis=0)

        own = {}
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column("block")[k].as_py()
                if block not in own:
                    b = load(batch, k)
                    loop = np.repeat((b.has == 3)[:, None], m, axis=1)
                    own[block] = b, (np.where(loop, leaky(b.ss + b.sd), -np.inf), loop.astype(float), b.h * loop[:, :, None])
                b, state = own[block]
                a = load(batch, k, "_")
                u, v, code = into(a, b)
                there = (a.nodes[u] != b.nodes[v]) & (a.has[u] > 0) & (b.has[v] > 0)
                u, v, code = u[there], v[there], code[there]
                for sign, at in ((1, 0), (-1, 3)):
                    before, after = BITS["in", sign], BITS["out", sign]
                    for motif, bit in ((at, before | after), (at + 1, before), (at + 2, after)):
                        add(state, a, b, motif, u[(code & bit) > 0], v[(code & bit) > 0])
                edge = (code & IN) > 0
                u, v, code = u[edge], v[edge], code[edge]
                for lo, hi, counts in third_nodes(a, b, u, v, bits):
                    for sign, at in ((1, 6), (-1, 22)):
                        signed = (code[lo:hi] & BITS["in", sign]) > 0
                        for j in range(len(bits)):
                            found = lo + np.flatnonzero(signed & (counts[:, j] > 0))
                            add(state, a, b, at + j, u[found], v[found])
        for b, (_, total, value) in own.values():
            step = max(1, ROWS // (m * out))
            for lo in range(0, len(b.nodes), step):
                sums = total[lo : lo + step]
                n, motif = np.nonzero(sums)
                val = value[lo : lo + step][n, motif] / sums[n, motif][:, None]
                pos = motif[:, None] * out + np.arange(out)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.nodes[lo + n], out)), pa.array(pos.ravel().astype("int32")), pa.array(val.ravel())], ["id", "pos", "val"])

    return run
