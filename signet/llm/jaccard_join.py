"""N-gram Jaccard join through a token-group matrix.

A document's set is its distinct shingles (hashes of WINDOW words). Equal sets are one entity. Every pair of
entities with a Jaccard index of LIMIT or more must end in one component:

1. Bound by tokens. In hash order, two linked sets share k tokens of their first |x| - ceil(LIMIT |x|) + k, for
   any k; with k = floor(SLACK |x|), an entity is dropped for good unless enough of its leading tokens occur in
   another entity. Documents that merely share a passage go here. What is left is counted again over whole sets.
2. Groups. A remaining entity goes to the group of the leader with which it shares most leading tokens: of the
   entities that have a token, the one whose leading tokens are shared most. Groups are similar documents, linked
   or not.
3. Token-group matrix. For each token, the groups whose union holds it. Only entities that share LIMIT of their
   tokens with other groups' unions go on. A query entity opens a group only if
   enough of its leading tokens lie in the group's union (the bound of step 1, now with k tokens against the
   union), and its own group always.
4. Open groups. Members linked with their group's leader are one component and need no comparison among
   themselves. The other members and the group's queries are dealt in blocks and meet all members; whole sets of
   two blocks are intersected by matrix products, and a block returns the edges of a spanning forest of its
   links, never all pairs.

All of it is exact: bounds are necessary conditions, and links are verified on whole sets. Tokens travel as
packed arrays, dealt by hash into buckets whose number follows the input. In step 1 a piece of text sends a token of
many of its documents twice, which is all that other pieces need to know. A group whose members are alike but
mostly not linked with its leader costs the product of those members and all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Table, components

WINDOW, PERCENT = 5, 80
#: Share of a set's tokens by which prefixes are longer than the shortest that is exact.
SLACK = 0.15
#: Bytes of text for each token bucket; a bucket's tokens are one task's arrays.
BUCKET_BYTES = 8 << 20
#: Bits of the map of the survivors' ids.
BITS = 1 << 23
#: Tokens of one bucket where whole sets are dealt; entities of a block that is compared at once.
BUCKET_TOKENS, BLOCK = 1_000_000, 1024


def needed(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set of n with a linked one."""
    return -(-n * PERCENT // 100)


def slack(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, (n * SLACK).astype(np.int64))


def prefix(n: np.ndarray) -> np.ndarray:
    """Leading tokens that are looked at: |x| - ceil(LIMIT |x|) + k."""
    return np.minimum(n, n - needed(n) + slack(n))


def least_shared(n: np.ndarray) -> np.ndarray:
    """Leading tokens that a linked pair shares at least, over all sizes the other set may have (LIMIT |x| and more)."""
    return slack(needed(n))


def shingle_sets(batch: pa.RecordBatch, column: str):
    """(n words, sorted distinct shingle hashes) of each text of the batch."""
    data, offsets = W.buffers(batch.column(batch.schema.get_field_index(column)))
    starts, ends, first = W.spans(data, offsets)
    h = W.word_hashes(data, starts, ends, lower=True)
    for i in range(len(offsets) - 1):
        own = h[first[i] : first[i + 1]]
        yield np.unique(W.windows(own, min(WINDOW, len(own)))) if len(own) else np.zeros(0, np.uint64)


def entity(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        a, b = tokens.sum(dtype=np.uint64), W.mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        return int(W.mix64(np.array([a * W._C1 + b * W._P + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


BLOBS = "bucket int, piece long, ids binary, sizes binary, tokens binary"


def _deal(entities: np.ndarray, tokens: list[np.ndarray], buckets: int, extra: np.ndarray | None = None):
    """Rows (bucket, piece, ids, sizes, tokens) of one piece: its tokens by bucket, in the order of its entities."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    flat = np.concatenate(tokens) if len(tokens) else np.zeros(0, np.uint64)
    yield from _blobs(_piece(entities), entities, np.repeat(np.arange(len(tokens)), sizes), flat, buckets, extra)


def _piece(entities: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(W.mix64(np.array([entities.view(np.uint64).sum(dtype=np.uint64) * W._P + np.uint64(len(entities))])).view(np.int64)[0])


def _blobs(piece: int | None, entities: np.ndarray, owner: np.ndarray, flat: np.ndarray, buckets: int, extra: np.ndarray | None = None):
    """One row for each bucket that has a token: as many rows as tokens at most, whatever the number of buckets."""
    if not len(flat):
        return
    bucket = (W.mix64(flat) % np.uint64(buckets)).astype(np.int64)
    order, starts = _runs(bucket)
    for lo, hi in zip(starts, np.append(starts[1:], len(flat)), strict=True):
        own = order[lo:hi]
        who, n = np.unique(owner[own], return_counts=True)
        yield int(bucket[own[0]]), piece, (entities[who] if extra is None else np.concatenate([entities[who][None, :], extra[:, who]])).tobytes(), n.astype(np.int32).tobytes(), flat[own].tobytes()


def _deal_leading(entities: np.ndarray, tokens: list[np.ndarray], buckets: int):
    """Leading tokens of a piece, combined: tokens that several of its entities have are counted here (a row without
    tokens, its counts in sizes) and go on for two of them only, in rows without a piece, which nobody counts again."""
    flat, owner, piece = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]), _piece(entities)
    order, starts = _runs(flat)
    size = np.diff(np.append(starts, len(flat)))
    many, place = np.empty(len(flat), bool), np.empty(len(flat), np.int64)
    many[order] = np.repeat(size > 1, size)
    place[order] = np.arange(len(flat)) - np.repeat(starts, size)
    counts = np.bincount(owner[many], minlength=len(tokens))
    hit = counts > 0
    if hit.any():
        yield piece % buckets, piece, entities[hit].tobytes(), counts[hit].astype(np.int32).tobytes(), None
    yield from _blobs(piece, entities, owner[~many], flat[~many], buckets)
    two = many & (place < 2)
    yield from _blobs(None, entities, owner[two], flat[two], buckets)


_BLOB_TYPES = [("bucket", pa.int32()), ("piece", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary())]


def _batch(rows, types):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(types)], [n for n, _ in types])


def _first_pass(buckets: int):
    types = [*_BLOB_TYPES, ("id", pa.int64()), ("n", pa.int64()), ("e", pa.int64()), ("k", pa.int64())]

    def run(batches):
        for batch in W.pieces(batches, "text"):
            ids, keys = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "k"))
            rows, held = [], {}
            for k, tokens in enumerate(shingle_sets(batch, "text")):
                e = entity(tokens)
                # the document's own row goes with the bucket of its entity
                rows.append((e % buckets, None, None, None, None, ids[k], len(tokens), e, keys[k]))
                if len(tokens):
                    held[e] = tokens[: int(prefix(np.array([len(tokens)]))[0])]
            if held:
                rows += [(*r, None, None, None, None) for r in _deal_leading(np.array(list(held), np.int64), list(held.values()), buckets)]
            for lo in range(0, len(rows), 2000):
                yield _batch(rows[lo : lo + 2000], types)

    return run


def _unpack(table: pa.Table, at: int):
    """(row of each occurrence, entities, groups or None, sizes, tokens) of a bucket's blobs."""
    ids = [np.frombuffer(x, np.int64) for x in table.column(at).to_pylist()]
    sizes = [np.frombuffer(x, np.int32) for x in table.column(at + 1).to_pylist()]
    tokens = [np.frombuffer(x, np.uint64) for x in table.column(at + 2).to_pylist()]
    return ids, sizes, tokens


def _runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(tokens, kind="stable")
    line = tokens[order]
    return order, np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)


def _shared(tokens: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each occurrence, whether its token has occurrences of different owners."""
    if not len(tokens):
        return np.zeros(0, bool)
    order, starts = _runs(tokens)
    own = owner[order]
    many = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
    out = np.empty(len(tokens), bool)
    out[order] = np.repeat(many, np.diff(np.append(starts, len(tokens))))
    return out


_DOC = ("id", "n", "e", "k")


def _count_shared(table: pa.Table) -> pa.Table:
    """Bucket -> for each blob, how many of each entity's tokens another entity has too; the documents' rows and the
    counts that pieces made themselves pass."""
    docs = table.filter(pa.compute.is_valid(table.column("e")))
    ready = table.filter(pa.compute.and_(pa.compute.is_null(table.column("e")), pa.compute.is_null(table.column("tokens"))))
    blobs = table.filter(pa.compute.is_valid(table.column("tokens")))
    ids, sizes, tokens = _unpack(blobs, blobs.schema.get_field_index("ids"))
    none = lambda n, t: pa.nulls(n, t)
    parts = [pa.table({"piece": none(len(docs), pa.int64()), "ids": none(len(docs), pa.binary()), "counts": none(len(docs), pa.binary()), **{c: docs.column(c) for c in _DOC}})]
    for counted in [ready.select(["piece", "ids", "sizes"]).rename_columns(["piece", "ids", "counts"])] + ([_crossing(blobs, ids, sizes, np.concatenate([np.repeat(w, s) for w, s in zip(ids, sizes, strict=True)]), np.concatenate(tokens))] if ids else []):
        parts.append(pa.table({**{c: counted.column(c) for c in ("piece", "ids", "counts")}, **{c: none(len(counted), pa.int64()) for c in _DOC}}))
    return pa.concat_tables(parts)


def _crossing(table: pa.Table, ids: list, sizes: list, owner: np.ndarray, flat: np.ndarray) -> pa.Table:
    """(piece, ids, counts): for each blob, how many of each entity's tokens another owner has too."""
    shared = _shared(flat, owner)
    rows, lo = [], 0
    for piece, x, s in zip(table.column("piece").to_pylist(), ids, sizes, strict=True):
        hi = lo + int(s.sum())
        if piece is None:  # counted where it came from
            lo = hi
            continue
        counts = np.add.reduceat(shared[lo:hi].astype(np.int32), np.concatenate([[0], np.cumsum(s)[:-1]]).astype(np.int64))
        lo, hit = hi, counts > 0
        if hit.any():
            rows.append((piece, x.reshape(-1, len(s))[0][hit].tobytes(), counts[hit].astype(np.int32).tobytes()))
    return pa.table({"piece": pa.array([r[0] for r in rows], pa.int64()), "ids": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})


def _count_crossing(table: pa.Table) -> pa.Table:
    """Bucket -> for each blob, how many of each entity's tokens the union of another group has too."""
    ids, sizes, tokens = _unpack(table, table.schema.get_field_index("ids"))
    group = np.concatenate([np.repeat(w.reshape(-1, len(s))[1], s) for w, s in zip(ids, sizes, strict=True)])
    return _crossing(table, ids, sizes, group, np.concatenate(tokens))


COUNTS = "piece long, ids binary, counts binary, id long, n long, e long, k long"


def _sum_counts(table: pa.Table) -> pa.Table:
    """All buckets' counts of one piece, added for each entity."""
    e = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
    c = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist()])
    who, at = np.unique(e, return_inverse=True)
    return pa.table({"e": pa.array(who), "shared": pa.array(np.bincount(at, weights=c).astype(np.int64))})


def _survivors(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Entities whose shared leading tokens reach the bound; a copy's piece counts the same, so the largest holds."""
    total = counts.filter("piece is not null").select("piece", "ids", "counts").groupBy("piece").applyInArrow(W.trimmed(_sum_counts), "e long, shared long")
    total = total.groupBy("e").agg(F.max("shared").alias("shared"))
    need = F.greatest(F.lit(1).cast("long"), (F.ceil(F.col("n") * PERCENT / F.lit(100)).cast("double") * F.lit(SLACK)).cast("long"))
    return sizes.join(total, "e").filter(F.col("shared") >= need)


def _sets(batches):
    """(e, n, weight, tokens) of the survivors' texts; a text of another entity whose key collides is left out."""
    types = [("e", pa.int64()), ("n", pa.int64()), ("weight", pa.int64()), ("tokens", pa.binary())]
    for batch in W.pieces(batches, "text"):
        e, weight = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("e", "weight"))
        rows = [(e[k], len(t), weight[k], t.tobytes()) for k, t in enumerate(shingle_sets(batch, "text")) if len(t) and entity(t) == e[k]]
        yield _batch(rows, types)


def _dealer(buckets: int, whole: bool, marked: bool):
    """Sets dealt by token with each entity's g; all tokens or leading ones; marked: with the last leading token too."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                get = lambda n: part.column(part.schema.get_field_index(n)).to_pylist()
                e, g = np.array(get("e"), np.int64), np.array(get("g"), np.int64)
                tokens = [np.frombuffer(x, np.uint64) for x in get("tokens")]
                if not len(e):
                    continue
                ahead = [t[: int(prefix(np.array([len(t)]))[0])] for t in tokens]
                extra = np.stack([g, np.array([t[-1] for t in ahead], np.uint64).view(np.int64)]) if marked else g[None, :]
                rows = list(_deal(e, tokens if whole else ahead, buckets, extra))
                for a in range(0, len(rows), 2000):
                    yield _batch(rows[a : a + 2000], _BLOB_TYPES)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Bucket -> leaders (e, leader, shared): leading tokens of e whose heaviest entity is the leader; and for each blob
    how many of each entity's tokens other entities have (piece, ids, counts)."""
    ids, sizes, tokens = _unpack(table, table.schema.get_field_index("ids"))
    own, weight, leads = (np.concatenate([np.repeat(w.reshape(3, -1)[k], s) for w, s in zip(ids, sizes, strict=True)]) for k in range(3))
    flat = np.concatenate(tokens)
    counted = _crossing(table, ids, sizes, own, flat)
    lead = flat <= leads.view(np.uint64)
    flat, own, weight = flat[lead], own[lead], weight[lead]
    order = np.lexsort((own, -weight, flat))
    flat, own = flat[order], own[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    first = np.repeat(own[starts], np.diff(np.append(starts, len(flat))))
    off = own != first
    own, first = own[off], first[off]
    order = np.lexsort((first, own))
    own, first = own[order], first[order]
    at = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (first[1:] != first[:-1])])) if len(own) else np.zeros(0, np.int64)
    none = lambda n, t: pa.nulls(n, t)
    led = pa.table({"e": pa.array(own[at]), "leader": pa.array(first[at]), "shared": pa.array(np.diff(np.append(at, len(own))).astype(np.int64)), "piece": none(len(at), pa.int64()), "ids": none(len(at), pa.binary()), "counts": none(len(at), pa.binary())})
    n = len(counted)
    return pa.concat_tables([led, pa.table({**{c: none(n, pa.int64()) for c in ("e", "leader", "shared")}, **{c: counted.column(c) for c in ("piece", "ids", "counts")}})])


def _open(table: pa.Table) -> pa.Table:
    """(e, g, shared): leading tokens of e in the bucket that the union of another group g holds; g is above e's group."""
    ids, sizes, tokens = _unpack(table, table.schema.get_field_index("ids"))
    entity_, group, leads = (np.concatenate([np.repeat(w.reshape(3, -1)[k], s) for w, s in zip(ids, sizes, strict=True)]) for k in range(3))
    flat = np.concatenate(tokens)
    lead = flat <= leads.view(np.uint64)
    # the matrix: one row for each token and group that holds it
    order = np.lexsort((group, flat))
    f, g = flat[order], group[order]
    keep = np.concatenate([[True], (f[1:] != f[:-1]) | (g[1:] != g[:-1])])
    f, g = f[keep], g[keep]
    flat, entity_, group = flat[lead], entity_[lead], group[lead]
    lo, hi = np.searchsorted(f, flat, "left"), np.searchsorted(f, flat, "right")
    # in a token's row groups ascend: the ones above the entity's own come after it
    found = []
    some = np.flatnonzero(hi - lo > 1)
    made = np.cumsum(hi[some] - lo[some])
    a = 0
    while a < len(some):  # about a million at a time, however many groups a token has
        z = max(a + 1, int(np.searchsorted(made, (made[a - 1] if a else 0) + (1 << 20), "right")))
        k, a = some[a:z], z
        n = hi[k] - lo[k]
        at = np.repeat(lo[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        e, own, other = np.repeat(entity_[k], n), np.repeat(group[k], n), g[at]
        up = other > own
        e, other = e[up], other[up]
        order = np.lexsort((other, e))
        e, other = e[order], other[order]
        cut = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (other[1:] != other[:-1])])) if len(e) else np.zeros(0, np.int64)
        found.append((e[cut], other[cut], np.diff(np.append(cut, len(e)))))
    cols = [np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(3)]
    order = np.lexsort((cols[1], cols[0]))
    e, other, n = (c[order] for c in cols)
    cut = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (other[1:] != other[:-1])])) if len(e) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, cut) if len(cut) else np.zeros(0, np.int64)
    return pa.table({"e": pa.array(e[cut], pa.int64()), "g": pa.array(other[cut], pa.int64()), "shared": pa.array(total.astype(np.int64), pa.int64())})


def overlaps(a: list[np.ndarray], b: list[np.ndarray], columns: int = 2048, few: int = 256) -> np.ndarray:
    """Sizes of all intersections of two lists of sets.

    Tokens that make few pairs add them one by one; tokens of many sets are columns of membership matrices, which
    are multiplied, some columns at a time."""
    out = np.zeros((len(a), len(b)), np.float32)
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    of_a, of_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    oa, ob = np.argsort(flat_a, kind="stable"), np.argsort(flat_b, kind="stable")
    flat_a, of_a, flat_b, of_b = flat_a[oa], of_a[oa], flat_b[ob], of_b[ob]
    tokens = np.intersect1d(flat_a, flat_b)
    if not len(tokens):
        return out
    la, lb = np.searchsorted(flat_a, tokens), np.searchsorted(flat_b, tokens)
    na, nb = np.searchsorted(flat_a, tokens, "right") - la, np.searchsorted(flat_b, tokens, "right") - lb
    light = na * nb <= few
    k = np.flatnonzero(light)
    made = np.cumsum(na[k] * nb[k])
    lo = 0
    while lo < len(k):  # about a million pairs at a time
        hi = max(lo + 1, int(np.searchsorted(made, (made[lo - 1] if lo else 0) + (1 << 20), "right")))
        t, lo = k[lo:hi], hi
        n = na[t] * nb[t]
        r = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        width = np.repeat(nb[t], n)
        x, y = of_a[np.repeat(la[t], n) + r // width], of_b[np.repeat(lb[t], n) + r % width]
        np.add.at(out.reshape(-1), x * len(b) + y, np.float32(1))
    k = np.flatnonzero(~light)
    for lo in range(0, len(k), columns):
        t = k[lo : lo + columns]
        x, y = np.zeros((len(a), len(t)), np.float32), np.zeros((len(b), len(t)), np.float32)
        for m, start, size, of in ((x, la, na, of_a), (y, lb, nb, of_b)):
            at = np.repeat(start[t] - np.concatenate([[0], np.cumsum(size[t])[:-1]]), size[t]) + np.arange(size[t].sum())
            m[of[at], np.repeat(np.arange(len(t)), size[t])] = 1
        out += x @ y.T
    return out


def _compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Loose members and queries (left) against members (right) of one group: edges of a forest of their links."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not left.num_rows or not right.num_rows:
        return none
    read = lambda t: (np.array(t.column(3).to_pylist(), np.int64), [np.frombuffer(x, np.uint64) for x in t.column(4).to_pylist()])
    (ea, a), (eb, b) = read(left), read(right)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    both = overlaps(a, b)
    names, where = np.unique(np.concatenate([ea, eb]), return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for x in range(len(ea)):
        hit = (100 * both[x] >= PERCENT * (na[x] + nb - both[x])) & (eb != ea[x])
        for y in np.flatnonzero(hit):
            p, q = find(int(where[x])), find(int(where[len(ea) + y]))
            if p != q:
                parent[q] = p
                edges.append((int(ea[x]), int(eb[y])))
    W.trim()
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())}) if edges else none


def _to_leader(batches):
    """(a, b) of members linked with their group's leader: b is the leader."""
    for batch in batches:
        e, lead, own, other = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("e", "lead", "tokens", "head"))
        rows = []
        for x, y, a, b in zip(e, lead, own, other, strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True)) if PERCENT * max(len(a), len(b)) <= 100 * min(len(a), len(b)) else 0
            if 100 * both >= PERCENT * (len(a) + len(b) - both):
                rows.append((x, y))
        yield _batch(rows, [("a", pa.int64()), ("b", pa.int64())])


def row_key(id_col: str, text_col: str):
    """64 bits that name a row by its id and text."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """(id, n_shingles, component_id), one row for each row of df; with keys also k (row_key) and group, a number that
    names the component whether or not its rows have ids (null for texts without words).

    Texts are lower-cased in A-Z; with fewer than WINDOW words the whole sequence is one shingle; null, empty
    and wordless texts have none, link with nothing and keep their own id. Equal sets link. Ids are integers; rows
    with a null id take part (two others may be linked through them), and name no component: a component of such rows
    alone has the id null. Repeated ids are rows of their own. An empty table gives none.
    """
    narrow = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    narrow = narrow.withColumn("k", row_key("id", "text"))  # where two texts share a key, their entities tell
    volume = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-volume // BUCKET_BYTES))
    doc_fields = "id long, n long, e long, k long"
    dealt = narrow.mapInArrow(_first_pass(buckets), f"{BLOBS}, {doc_fields}")
    counts = Table(dealt.groupBy("bucket").applyInArrow(W.trimmed(_count_shared), COUNTS), "counts")
    docs = counts.df.filter("e is not null").select("id", "n", "e", "k")
    reps = docs.filter("n > 0").groupBy("e").agg(F.min("id").alias("rep"), F.min("k").alias("k"), F.max("n").alias("n"))
    # an original whose copies differ has all its leading tokens in others: the share is what makes a leader
    share = (F.col("shared") * 1_000_000 / F.col("n")).cast("long")
    alive = Table(_survivors(counts.df, reps).select("e", "k", share.alias("weight")), "alive").df
    # a bit map of the survivors' keys, of a fixed size, keeps most other texts out of the exchange; what it lets through
    # wrongly the join drops
    bit = F.pmod("k", F.lit(BITS))
    words = alive.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    marked = narrow.select("k", "text").withColumn("bit", bit).withColumn("word", F.expr("bit div 64"))
    likely = marked.join(F.broadcast(words), "word").filter(F.expr("shiftright(bits, cast(bit % 64 as int)) & 1 = 1")).select("k", "text")  # BITS / 64 rows at most
    texts = likely.join(alive.hint("merge"), "k").select("k", "e", "weight", "text").dropDuplicates(["k", "text", "e"])
    sets = Table(texts.select("e", "weight", "text").mapInArrow(_sets, "e long, n long, weight long, tokens binary"), "sets").df
    buckets_of = lambda df: max(1, -(-(df.agg(F.sum("n")).first()[0] or 0) // BUCKET_TOKENS))

    # one exchange of whole sets: the bound over all tokens, which is LIMIT, and the leaders
    met = sets.withColumnRenamed("weight", "g").mapInArrow(_dealer(buckets_of(sets), True, True), BLOBS).groupBy("bucket").applyInArrow(W.trimmed(_meet), "e long, leader long, shared long, piece long, ids binary, counts binary")
    met = Table(met, "met").df
    count = met.filter("piece is not null").select("piece", "ids", "counts").groupBy("piece").applyInArrow(W.trimmed(_sum_counts), "e long, shared long")
    near = Table(sets.select("e", "n").join(count, "e").filter(F.col("shared") * 100 >= F.col("n") * PERCENT).select("e"), "near").df
    best = met.filter("leader is not null").groupBy("e", "leader").agg(F.sum("shared").alias("shared")).groupBy("e").agg(F.max(F.struct("shared", "leader")).alias("m")).select("e", "m.leader")
    best = Table(best.join(near, "e", "left_semi").join(near.withColumnRenamed("e", "leader"), "leader", "left_semi").select("e", "leader"), "leaders").df
    groups = components(best, "e", "leader").select(F.col("node").alias("e"), F.col("root").alias("g"))
    placed = Table(near.join(groups, "e", "left").select("e", F.coalesce("g", "e").alias("g")), "placed").df
    grouped = Table(sets.select("e", "n", "tokens").join(placed.hint("merge"), "e"), "grouped").df
    few = buckets_of(grouped)

    # a link to another group shares its tokens with that group's union: entities without that many can have none, and
    # are left out on both sides
    across = grouped.mapInArrow(_dealer(few, True, False), BLOBS).groupBy("bucket").applyInArrow(W.trimmed(_count_crossing), "piece long, ids binary, counts binary")
    across = across.groupBy("piece").applyInArrow(W.trimmed(_sum_counts), "e long, shared long")
    open_ = Table(grouped.select("e", "n").join(across, "e").filter(F.col("shared") * 100 >= F.col("n") * PERCENT).select("e"), "open").df
    facing = grouped.join(open_, "e", "left_semi")
    matrix = facing.mapInArrow(_dealer(few, True, True), BLOBS).groupBy("bucket").applyInArrow(W.trimmed(_open), "e long, g long, shared long")
    matrix = matrix.groupBy("e", "g").agg(F.sum("shared").alias("shared")).join(grouped.select("e", "n"), "e")
    crossing = matrix.filter(F.col("shared") >= F.greatest(F.lit(1).cast("long"), (F.col("n") * F.lit(SLACK)).cast("long"))).select("e", "g")
    opened = Table(crossing, "opened").df
    # the member that most others chose as leader; those linked with it need no other comparison within the group
    fans = best.join(placed, "e").groupBy("g", "leader").agg(F.count("*").alias("c")).groupBy("g").agg(F.max(F.struct("c", "leader")).alias("m")).select("g", F.col("m.leader").alias("lead"))
    heads = fans.join(grouped.select(F.col("e").alias("lead"), F.col("tokens").alias("head")), "lead")
    tight = Table(grouped.join(heads.hint("merge"), "g").filter("e <> lead").mapInArrow(_to_leader, "a long, b long"), "tight").df
    bound = tight.select(F.col("a").alias("e")).union(fans.select("lead"))
    loose = Table(grouped.select("g", "e").join(bound, "e", "left_anti"), "loose").df
    blocks = F.ceil(F.count("*") / BLOCK).cast("int")
    shape = grouped.groupBy("g").agg(blocks.alias("nb"), F.count("*").alias("m"))
    for part, name in ((loose, "lb"), (opened, "qb")):
        shape = shape.join(part.groupBy("g").agg(blocks.alias(name)), "g", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    shape = shape.filter("(lb > 0 and m > 1) or qb > 0").drop("m")
    block = lambda n: F.pmod(F.xxhash64("e"), F.col(n)).cast("int")
    each = lambda lo, hi: F.explode(F.sequence(lo, hi))
    # loose members: blocks from 0; queries from other groups: blocks below 0; each against all blocks of members
    last = F.col("nb") - 1
    own = loose.join(shape.filter("lb > 0"), "g").join(grouped.select("e", "tokens"), "e")
    asked = opened.join(shape, "g").join(grouped.select("e", "tokens"), "e")
    left = own.select("g", block("lb").alias("i"), each(F.lit(0), last).alias("j"), "e", "tokens").union(
        asked.select("g", (-1 - block("qb")).alias("i"), each(F.lit(0), last).alias("j"), "e", "tokens"))
    members = grouped.select("g", "e", "tokens").join(shape, "g")
    right = members.select(F.col("g").alias("h"), each(-F.col("qb"), F.col("lb") - 1).alias("x"), block("nb").alias("y"), F.col("e").alias("f"), F.col("tokens").alias("t"))
    links = left.groupBy("g", "i", "j").cogroup(right.groupBy("h", "x", "y")).applyInArrow(_compare, "a long, b long")
    links = Table(links.union(tight), "links").df

    # components over entities, each named by the smallest id in it; entities without a link are their own
    roots = Table(components(links).select(F.col("node").alias("e"), "root").join(reps.select("e", "rep"), "e"), "roots").df
    named = roots.join(roots.groupBy("root").agg(F.min("rep").alias("component")), "root").select("e", "root", "component")
    of = reps.select("e", "rep").join(named.withColumn("linked", F.lit(True)), "e", "left").select("e", F.when(F.col("linked"), F.col("component")).otherwise(F.col("rep")).alias("component"), F.coalesce("root", "e").alias("group"))
    joined = docs.select("id", "n", "e", "k").join(of, "e", "left")
    return joined.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"), *["k", "group"] * keys)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join(docs).withColumnRenamed("id", "doc_id")


def op5_sql() -> str:
    """Independent SQL: shingles as lists of words, all pairs that share one, components by recursion."""
    return f"""
with recursive w as (
  select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as words from documents),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < {WINDOW} then [array_to_string(words, ' ')]
  else list_distinct(list_transform(range(1, len(words) - {WINDOW} + 2), lambda i: array_to_string(words[i : i + {WINDOW - 1}], ' '))) end as sh from w),
n as (select doc_id, len(sh)::bigint as n_shingles, list_sort(list_transform(sh, lambda x: hash(x))) as key from s),
k as (select doc_id, n_shingles, min(doc_id) over (partition by key, n_shingles) as rep from n),
t as materialized (select s.doc_id as d, unnest(sh) as x, len(sh) as n from s join k using (doc_id) where k.rep = s.doc_id),
p as materialized (select a.d as a, b.d as b from t a join t b on a.x = b.x and a.d < b.d group by a.d, b.d, a.n, b.n
  having 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
l as materialized (select a, b from p union all select b, a from p),
reach as (select distinct rep as a, rep as b from k where n_shingles > 0 union select r.a, l.b from reach r join l on r.b = l.a),
c as (select a as rep, min(b) as component from reach group by a)
select k.doc_id, n_shingles, case when n_shingles = 0 then k.doc_id else component end as component_id
from k left join c on k.rep = c.rep
"""
