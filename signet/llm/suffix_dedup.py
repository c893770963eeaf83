"""Removal of repeated passages by suffix arrays.

Every byte that lies in a string of SPAN bytes which also starts in a document of a smaller id is removed.

1. Anchors. The least hash of the GRAM-byte strings inside a SPAN-byte window is the window's anchor. Equal
   windows have equal anchors, so documents with different anchors share nothing there, and runs of windows with
   one anchor (segments) are dealt by it: 11 bytes for each segment, packed, and about 5 that name its text, to
   buckets whose number follows the input. The texts' own keys go once for each DEAL bytes of text, not to every bucket.
2. Classes. Segments of an anchor with equal bytes are a class; in a class all but the smallest id are
   covered whole. Where an anchor has several classes, their windows may agree in part: one segment a class
   goes on with its bytes.
3. Suffix arrays. Segments are clipped to what they can share (longest agreement left and right of the anchor with
   any other segment of it), equal ones become one part, and a part that is alone with its anchor needs no array. The
   others are joined with separators, one byte for the anchor's string in each; the suffix array is built by linear
   grouping (suffix_array.py), and neighbours that agree in a window form runs; windows of a run that do not
   belong to its smallest id are covered.

Anchors, classes and arrays see every window of every document. Classes rest on 88 bits of hash, arrays on the
bytes, rows are named by 128 bits. Anchors of more than HOT classes are split: a segment's windows go on in up to four
ranges of the anchor's place in them, each dealt by the 43 or 44 bytes that all windows of the range have around the anchor, so
that no anchor is one task's array. The text is dealt once: both uses of it, for the segments' bytes and for the
result, take the same columns, so the plan has one exchange for them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import Table
from .suffix_array import END, SEPARATOR, SHIFT, suffix_array

SPAN, GRAM = 50, 20
#: Windows of one segment at most; text bytes for each bucket; bytes of joined segments for
#: each array: what Python holds of an array of this size stays in a core's cache.
LONGEST, BUCKET_BYTES, ARRAY = 512, 8 << 20, 8_000
#: Text bytes whose segments are dealt together: one row for each bucket.
DEAL = 8 << 20
#: Classes of an anchor above which its windows are dealt by more of their bytes, in these ranges of the anchor's place.
HOT = 4096
RANGES = ((0, 7), (8, 15), (16, 23), (24, SPAN - GRAM))
_H = np.uint64((1 << 48) - 1)
_G = np.uint64((1 << 40) - 1)
_PLACE = np.uint64((1 << 21) - 1)
NONE, COVERED, PARTLY, SPLIT = 0, 1, 2, 3


def segments(data: np.ndarray, offsets: np.ndarray):
    """(text number, start, end, anchor, class, place) of all segments, in order; end - start - SPAN + 1 windows each.

    place is where the anchor's string begins, -1 where the segment's windows do not all have it there."""
    out = []
    i, last = 0, len(offsets) - 1
    while i < last:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + W.PIECE, "right")) - 1)
        # a text longer than a piece goes in pieces that overlap by a window less one byte
        lo, end = int(offsets[i]), int(offsets[j])
        for a in range(lo, max(lo + 1, end - SPAN + 1), W.PIECE):
            out.append(_segments(data, offsets[i : j + 1], i, a, min(end, a + W.PIECE + SPAN - 1) if j == i + 1 else end))
            if j > i + 1:
                break
        i = j
    return [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(6)]


def _anchors(d: np.ndarray):
    """(running sums, inverse powers, hashes, place) of a text's bytes; place is where the anchor of each window first
    begins, in the window, and hashes has the anchor there."""
    n, w = len(d), SPAN - GRAM + 1
    power, inverse = W._powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        byte = d.astype(np.uint64)
        byte += np.uint64(1)
        byte *= power[:n]
        np.cumsum(byte, out=total[1:])
        gram = total[GRAM:] - total[:-GRAM]
        gram *= inverse[: n - GRAM + 1]
    gram = W.mix64(gram)
    # least hash of each window and its first place, packed into one number
    low = gram & ~_PLACE
    low |= np.arange(len(gram), dtype=np.uint64)
    m, span = len(low) - w + 1, 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:m], low[w - span : w - span + m])
    low &= _PLACE
    return total, inverse, gram, low.view(np.int64)


def _segments(data, offsets, number, a, b):
    d = data[a:b]
    none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)]
    if len(d) < SPAN:
        return none
    total, inverse, gram, place = _anchors(d)
    m = len(place)
    # where the anchor moves it may be another; texts begin anew, and windows that leave their text follow its last one
    edge = np.clip(offsets, a, b) - a
    moved = np.flatnonzero(place[1:] != place[:-1]) + 1
    moved = moved[gram[place[moved]] != gram[place[moved - 1]]]
    cut = np.zeros(len(d) + 1, bool)
    cut[moved] = True
    cut[edge[:-1]] = True
    cut[np.maximum(edge[1:] - SPAN + 1, edge[:-1])] = True
    at = np.flatnonzero(cut[:m])
    after = np.append(at[1:], m)
    of = np.searchsorted(edge, at, "right") - 1
    inside = at + SPAN <= edge[of + 1]
    at, after, of = at[inside], after[inside], of[inside]
    if not len(at):
        return none
    size = after - at
    if size.max() > LONGEST:
        parts = -(-size // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        of, after = np.repeat(of, parts), np.repeat(after, parts)
        at = np.repeat(at, parts) + nth * LONGEST
        after = np.minimum(after, at + LONGEST)
    start, end = at, after - 1 + SPAN
    with np.errstate(over="ignore"):
        whole = W.mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    first = place[at]
    return of + number, start + a, end + a, gram[first] & _H, whole & _G, np.where(end - SPAN <= first, first + a, -1)


def _pack(h: np.ndarray, g: np.ndarray) -> bytes:
    return np.concatenate([h.view(np.uint8).reshape(-1, 8)[:, :6], g.view(np.uint8).reshape(-1, 8)[:, :5]], axis=1).tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 11)
    wide = np.zeros((len(rows), 16), np.uint8)
    wide[:, :6], wide[:, 8:13] = rows[:, :6], rows[:, 6:]
    both = wide.view(np.uint64)
    return both[:, 0].copy(), both[:, 1].copy()


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (W.mix64(h) % np.uint64(buckets)).astype(np.int64)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers (one at least) as the least of them, then the bytes that each has above it: all last bytes, all before the last and so on."""
    low = x.min()
    over = (x - low).view(np.uint64)  # may wrap, and wraps back
    width = max(1, -(-int(over.max()).bit_length() // 8))
    return low.tobytes() + bytes([width]) + over.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _widen(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=9).reshape(raw[8], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : raw[8]] = planes.T
    return wide.view(np.int64)[:, 0] + np.frombuffer(raw, np.int64, 1)


#: A bucket below 0 has the keys of a piece's texts in `texts`, others have their numbers in the piece, less the one before.
BLOBS = "bucket int, piece long, texts binary, ids binary, sizes binary, segments binary"
_BLOB_TYPES = [("bucket", pa.int32()), ("piece", pa.int64()), ("texts", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("segments", pa.binary())]


def _rows(rows, types):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(types)], [n for n, _ in types])


def _numbers(batch, name):
    return np.array(batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False), np.int64)


def _keys(batch) -> np.ndarray:
    """Two 64-bit hashes that name each row."""
    return np.stack([_numbers(batch, "key"), _numbers(batch, "key2")], axis=1)


def _blobs(held: list, buckets: int, number: int):
    """Rows of BLOBS for texts that are dealt together."""
    first = np.cumsum([0, *[len(key) for key, *_ in held]])
    key, rank = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
    text = np.concatenate([x[2] + n for x, n in zip(held, first, strict=False)])
    h, g = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])
    if not len(text):
        return
    # the keys in their order are part of the name: rows of two attempts that read in different orders never mix
    with np.errstate(over="ignore"):
        own = W.mix64(key.view(np.uint64).ravel() + np.arange(key.size, dtype=np.uint64) * W._P).sum(dtype=np.uint64)
        piece = int(W.mix64(np.array([own + W.mix64(np.array([number], np.uint64))[0]])).view(np.int64)[0])
    yield -1 - piece % buckets, piece, key.tobytes(), None, None, None
    b = _bucket(h, buckets)
    order = np.argsort(b, kind="stable")
    line = b[order]
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(line)], strict=True):
        own = order[lo:hi]
        at = np.flatnonzero(np.concatenate([[True], np.diff(text[own]) != 0]))
        who = text[own[at]]
        yield int(line[lo]), piece, _narrow(np.diff(who, prepend=0)), _narrow(rank[who]), _narrow(np.diff(at, append=hi - lo)), _pack(h[own], g[own])


def _deal(buckets: int):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def out(held):
            rows, size = [], 0
            for row in _blobs(held, buckets, number):
                rows.append(row)
                size += sum(len(x) for x in row[2:] if x)
                if size >= 1 << 20 or len(rows) >= 1000:
                    yield _rows(rows, _BLOB_TYPES)
                    rows, size = [], 0
            if rows:
                yield _rows(rows, _BLOB_TYPES)

        held, size = [], 0
        for batch in W.pieces(batches, "text"):
            data, offsets = W.buffers(batch.column(batch.schema.get_field_index("text")))
            text, _, _, h, g, _ = segments(data, offsets)
            held.append((_keys(batch), _numbers(batch, "rank"), text, h, g))
            size += len(data)
            if size >= DEAL:
                yield from out(held)
                held, size, number = [], 0, number + 1
        if held:
            yield from out(held)

    return run


def states(h: np.ndarray, g: np.ndarray, rank: np.ndarray, hot: int = HOT) -> np.ndarray:
    """NONE, COVERED, PARTLY (its bytes decide) or SPLIT (its windows' bytes) for each segment of a bucket."""
    out = np.zeros(len(h), np.uint8)
    order = np.argsort(h, kind="stable")
    line = h[order]
    start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    own = rank[order]
    many = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)
    order = order[np.repeat(many, np.diff(np.append(start, len(h))))]
    if not len(order):
        return out
    order = order[np.lexsort((rank[order], g[order], h[order]))]
    hh, gg, rr = h[order], g[order], rank[order]
    anchor = np.concatenate([[True], hh[1:] != hh[:-1]])
    kind = anchor | np.concatenate([[True], gg[1:] != gg[:-1]])
    first = np.flatnonzero(kind)
    least = np.repeat(rr[first], np.diff(np.append(first, len(order))))
    begin = np.flatnonzero(anchor)
    kinds = np.repeat(np.add.reduceat(kind.astype(np.int64), begin), np.diff(np.append(begin, len(order))))
    out[order] = np.where(rr > least, COVERED, np.where(kinds > hot, SPLIT, np.where(kinds > 1, PARTLY, NONE)))
    return out


CLASSIFIED = "piece long, bucket int, texts binary, sizes binary, states binary"


def _classify(table: pa.Table, hot: int = HOT) -> pa.Table:
    """A bucket's blobs -> CLASSIFIED; keys of texts go on to their pieces as they are."""
    get = lambda n: table.column(n).to_pylist()
    if table.column("bucket")[0].as_py() < 0:
        parts = [None] * len(table)
    else:
        sizes = [_widen(x) for x in get("sizes")]
        rank = np.concatenate([np.repeat(_widen(r), s) for r, s in zip(get("ids"), sizes, strict=True)])
        both = [_unpack(x) for x in get("segments")]
        state = states(np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both]), rank, hot)
        ends = np.cumsum([int(s.sum()) for s in sizes])
        parts = [state[e - int(s.sum()) : e].tobytes() for e, s in zip(ends, sizes, strict=True)]
    return pa.table({"piece": table.column("piece"), "bucket": table.column("bucket"), "texts": table.column("texts"), "sizes": table.column("sizes"), "states": pa.array(parts, pa.binary())})


def _by_text(table: pa.Table) -> pa.Table:
    """All buckets of one piece -> (key, key2, states) for each text with a state: states in the order of buckets."""
    order = np.argsort(np.array(table.column("bucket").to_pylist()), kind="stable")
    get = lambda n: [table.column(n)[int(k)].as_py() for k in order]
    (names, *texts), sizes = get("texts"), get("sizes")[1:]
    key = np.frombuffer(names, np.int64).reshape(-1, 2)
    who = np.concatenate([np.repeat(np.cumsum(_widen(t)), _widen(s)) for t, s in zip(texts, sizes, strict=True)])
    state = np.frombuffer(b"".join(get("states")[1:]), np.uint8)
    at = np.argsort(who, kind="stable")
    who, state = who[at], state[at]
    start = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    ends = np.append(start[1:], len(who))
    some = np.maximum.reduceat(state, start) > 0
    found = key[who[start[some]]]
    return pa.table({"key": pa.array(found[:, 0].copy()), "key2": pa.array(found[:, 1].copy()), "states": pa.array([state[a:b].tobytes() for a, b in zip(start[some], ends[some], strict=True)], pa.binary())})


def _stated(batch, buckets: int):
    """(text number, start, end, anchor, place, state) of the segments with a state, of texts joined with their states."""
    data, offsets = W.buffers(batch.column(batch.schema.get_field_index("text")))
    text, start, end, h, _, place = segments(data, offsets)
    state = np.zeros(len(text), np.uint8)
    raw = batch.column(batch.schema.get_field_index("states"))
    own = np.flatnonzero(raw.is_valid().to_numpy(zero_copy_only=False)[text])
    if len(own):  # a text's states are in the order of buckets
        order = np.lexsort((_bucket(h[own], buckets), text[own]))
        state[own[order]] = np.frombuffer(b"".join(x for x in raw.to_pylist() if x is not None), np.uint8)
    some = state > 0
    return data, offsets, text[some], start[some], end[some], h[some], place[some], state[some]


def placed(raw: bytes):
    """(first, last, place) of runs of a segment's windows that have the anchor in one place."""
    places = _anchors(np.frombuffer(raw, np.uint8))[3]
    at = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])).tolist()
    return [(a, b - 1, int(places[a])) for a, b in zip(at, [*at[1:], len(places)], strict=True)]


def ranges(raw: bytes, place: int):
    """(name, start, end, place) of the windows of a segment by RANGES. place: the anchor's, -1 where it is not one.

    Equal windows have the anchor at the same place, and name is a hash of the bytes that all windows of the range have
    around it, so they meet under one name."""
    for first, last, p in [(0, len(raw) - SPAN, place)] if place >= 0 else placed(raw):
        for k, (least, most) in enumerate(RANGES):
            lo, hi = max(first, p - most), min(last, p - least)
            if lo <= hi:
                held = bytes([k]) + raw[p - least : p - most + SPAN]
                yield int.from_bytes(hashlib.blake2b(held, digest_size=6).digest(), "big"), lo, hi + SPAN, p


def _material(buckets: int):
    types = [("anchor", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("rank", pa.int64()), ("at", pa.int64()), ("anchor_at", pa.int64()), ("bytes", pa.binary())]

    def run(batches):
        for batch in W.pieces(batches, "text"):
            key, rank = _keys(batch), _numbers(batch, "rank")
            data, offsets, text, start, end, h, place, state = _stated(batch, buckets)
            rows = []
            for k in np.flatnonzero(state >= PARTLY):
                i, a, b = text[k], int(start[k]), int(end[k])
                who, raw = (int(key[i, 0]), int(key[i, 1]), int(rank[i])), data[a:b].tobytes()
                if state[k] == SPLIT:
                    at = int(a - offsets[i])
                    rows += [(name, *who, at + lo, p - lo, raw[lo:hi]) for name, lo, hi, p in ranges(raw, int(place[k] - a) if place[k] >= 0 else -1)]
                else:
                    rows.append((int(h[k]), *who, int(a - offsets[i]), int(place[k] - a) if place[k] >= 0 else -1, raw))
                if len(rows) >= 8192:
                    yield _rows(rows, types)
                    rows = []
            if rows:
                yield _rows(rows, types)

    return run


def covered_windows(parts: list[bytes], ranks: list[int], span: int = SPAN, groups: list[int] | None = None) -> list[np.ndarray]:
    """For each part, the starts of its windows of `span` bytes that a part of a smaller rank (and the same group) also has."""
    return _covered([p.translate(SHIFT) for p in parts], ranks, span, groups)


def _covered(parts: list[bytes], ranks: list[int], span: int, groups: list[int] | None) -> list[np.ndarray]:
    t = SEPARATOR.join(parts) + SEPARATOR + END
    order = np.array(suffix_array(t), np.int64)
    first = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    part = np.searchsorted(first, order, "right") - 1
    inside = part < len(parts)
    size = np.array([len(p) for p in parts] + [0])
    inside &= order - first[part] + span <= size[np.minimum(part, len(parts))]
    order, part = order[inside], part[inside]
    out = [np.zeros(0, np.int64)] * len(parts)
    if not len(order):
        return out
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(t, np.uint8), span)
    same = np.concatenate([(view[order[k : k + 65536]] == view[order[k + 1 : k + 65537]][: len(order[k : k + 65536])]).all(axis=1) if k + 65537 <= len(order) else (view[order[k:-1]] == view[order[k + 1 :]]).all(axis=1) for k in range(0, len(order) - 1, 65536)]) if len(order) > 1 else np.zeros(0, bool)
    begins = np.concatenate([[True], ~same])
    if groups is not None:  # a run of equal windows, group by group
        run, group = np.cumsum(begins), np.array(groups, np.int64)[part]
        by = np.lexsort((group, run))
        order, part, run, group = order[by], part[by], run[by], group[by]
        begins[1:] = (run[1:] != run[:-1]) | (group[1:] != group[:-1])
    start = np.flatnonzero(begins)
    rank = np.array(ranks, np.int64)[part]
    least = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(order))))
    hit = rank > least
    at, of = order[hit] - first[part[hit]], part[hit]
    by = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[by], np.arange(len(parts) + 1))
    return [np.sort(at[by[cuts[k] : cuts[k + 1]]]) for k in range(len(parts))]


def _shared_length(anchor: list[int], sides: list[bytes], width: int) -> np.ndarray:
    """For each side, the longest start that a side of the same anchor shares: with a neighbour in sorted order."""
    keys = np.frombuffer(b"".join(a.to_bytes(6, "big") + x.ljust(width, b"\0") for a, x in zip(anchor, sides, strict=True)), f"S{6 + width}")
    order = np.argsort(keys)
    view = keys.view(np.uint8).reshape(len(keys), 6 + width)[order]
    differ = view[1:] != view[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), 6 + width) if len(keys) > 1 else np.zeros(0, np.int64)
    same = np.maximum(same - 6, 0)
    out = np.zeros(len(keys), np.int64)
    out[order] = np.maximum(np.append(0, same), np.append(same, 0))
    return np.minimum(out, [len(x) for x in sides])


def clipped(anchor: list[int], place: list[int], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(first, after) of each segment's bytes that a window shared with another segment of its anchor can reach.

    A window holds its anchor's string, so what it shares reaches no further left and right of it than the longest
    agreement with any other segment there."""
    reach = SPAN - GRAM
    left = _shared_length(anchor, [x[max(0, p - reach) : p][::-1] for p, x in zip(place, raw, strict=True)], reach)
    right = _shared_length(anchor, [x[p + GRAM : p + GRAM + reach] for p, x in zip(place, raw, strict=True)], reach)
    return np.array(place) - left, np.array(place) + GRAM + right


def merged(spans: list[np.ndarray]) -> np.ndarray:
    """The union of some spans, as spans in order that do not touch."""
    if len(spans) == 1:
        return spans[0]
    both = np.concatenate(spans)
    both = both[np.argsort(both[:, 0], kind="stable")]
    end = np.maximum.accumulate(both[:, 1])
    cut = np.flatnonzero(both[1:, 0] > end[:-1])
    return np.stack([both[np.concatenate([[0], cut + 1]), 0], end[np.append(cut, len(end) - 1)]], axis=1)


#: Stands for an anchor's string where parts are joined: no byte of UTF-8, and SHIFT leaves it as it is.
ANCHOR = b"\xff"


def _arrays(table: pa.Table) -> pa.Table:
    """Segments of some anchors -> (key, key2, spans) with spans as pairs of int64 (start, end in the text).

    Every window of a clipped part holds the anchor's string once at the part's place for it, so one byte stands for that
    string and windows are compared within their anchor. A part that is alone with its string shares no window."""
    names = ("anchor", "key", "key2", "rank", "at", "anchor_at", "bytes")
    rows = list(zip(*(table.column(n).to_pylist() for n in names), strict=True))
    loose = [r for r in rows if r[5] < 0]
    if loose:
        rows = [r for r in rows if r[5] >= 0]
        rows += [(*r[:4], r[4] + lo, p - lo, r[6][lo : hi + SPAN]) for r in loose for lo, hi, p in placed(r[6])]
    anchor, key, key2, rank, at, place, raw = (list(x) for x in zip(*rows, strict=True))
    del rows, loose
    first, after = (x.tolist() for x in clipped(anchor, place, raw))
    spans: dict[tuple[int, int], list[np.ndarray]] = {}
    # by anchor and its string, for two strings may have one hash: rows of each part
    groups: dict[tuple[int, bytes], dict[bytes, list[int]]] = {}
    for r, (a, p, x, lo, hi) in enumerate(zip(anchor, place, raw, first, after, strict=True)):
        if hi - lo >= SPAN:
            groups.setdefault((a, x[p : p + GRAM]), {}).setdefault(x[lo:hi], []).append(r)

    def add(rows: list[int], low: int, length: int, starts=()):
        whole = np.array([[0, length]], np.int64)
        own = None
        if len(starts):
            gap = np.flatnonzero(np.diff(starts) > SPAN)
            own = np.stack([starts[np.concatenate([[0], gap + 1])], starts[np.append(gap, len(starts) - 1)] + SPAN], axis=1)
        for r in rows:
            found = whole if rank[r] > low else own
            if found is not None:
                spans.setdefault((key[r], key2[r]), []).append(found + (at[r] + first[r]))

    def flush(held):
        parts = [(part.translate(SHIFT), rows, n) for n, own in enumerate(held) for part, rows in own.items()]
        short = []
        for part, rows, _ in parts:
            p = place[rows[0]] - first[rows[0]]
            short.append(part[:p] + ANCHOR + part[p + GRAM :])
        least = [min(rank[r] for r in rows) for _, rows, _ in parts]
        starts = _covered(short, least, SPAN - GRAM + 1, [n for *_, n in parts])
        for (part, rows, _), low, found in zip(parts, least, starts, strict=True):
            add(rows, low, len(part), found)

    batch, held = [], 0
    for own in groups.values():
        if len(own) == 1:
            ((part, rows),) = own.items()
            if len(rows) > 1:
                add(rows, min(rank[r] for r in rows), len(part))
            continue
        batch.append(own)
        held += sum(len(part) - GRAM + 1 for part in own)
        if held >= ARRAY:
            flush(batch)
            batch, held = [], 0
    if batch:
        flush(batch)
    return pa.table({"key": pa.array([k for k, _ in spans], pa.int64()), "key2": pa.array([k for _, k in spans], pa.int64()), "spans": pa.array([merged(x).tobytes() for x in spans.values()], pa.binary())})


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _finish(buckets: int, extra: tuple[str, ...], payload: bool):
    def run(batches):
        for batch in W.pieces(batches, "text"):
            data, offsets, text, start, end, _, _, state = _stated(batch, buckets)
            first = np.searchsorted(text, np.arange(len(offsets)))
            rows = []
            for i, more in enumerate(batch.column(batch.schema.get_field_index("spans")).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                k = slice(first[i], first[i + 1])
                full = state[k] == COVERED
                lo, hi = start[k][full] - offsets[i], end[k][full] - offsets[i]
                if more:
                    got = np.frombuffer(b"".join(more), np.int64).reshape(-1, 2)
                    lo, hi = np.concatenate([lo, got[:, 0]]), np.concatenate([hi, got[:, 1]])
                removed = spans = 0
                if len(lo):
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, hi, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, spans = int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                    kept = own[~gone].tobytes()
                else:
                    kept = own.tobytes()
                rows.append((len(own), removed, spans, hashlib.sha256(kept).hexdigest(), kept if payload else None))
            types = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in extra], *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], [*extra, *[c.split()[0] for c in RESULT.split(", ")]])

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), payload: bool = True, hot: int = HOT) -> DataFrame:
    """id, the columns named in keep, then n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes; null without payload).

    Texts are UTF-8 bytes, null texts empty. Ids are integers; rows that repeat an id never cover each other, and a
    null id counts as larger than all others. Texts shorter than SPAN keep all. An empty table gives none.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rank = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(9223372036854775807).cast("long"))
    base = df.select(F.col(f"`{id_col}`").alias("__id"), *[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(keep)], F.xxhash64(F.col(f"`{id_col}`"), text).alias("key"), F.xxhash64(text, F.col(f"`{id_col}`"), F.lit(1)).alias("key2"), rank.alias("rank"), text.alias("text"))
    volume = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-volume // BUCKET_BYTES))
    dealt = base.select("key", "key2", "rank", "text").mapInArrow(_deal(buckets), BLOBS).groupBy("bucket").applyInArrow(W.trimmed(lambda t: _classify(t, hot)), CLASSIFIED)
    # equal rows have equal states and one key
    state = Table(dealt.groupBy("piece").applyInArrow(W.trimmed(_by_text), "key long, key2 long, states binary").dropDuplicates(["key", "key2"]), "states").df
    # both uses take all columns: were some left out of one, the text would be dealt twice
    stated = base.join(state, ["key", "key2"], "left")
    several = stated.mapInArrow(_material(buckets), "anchor long, key long, key2 long, rank long, at long, anchor_at long, bytes binary")
    groups = max(1, buckets // 2)
    spans = several.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(groups))).applyInArrow(W.trimmed(_arrays), "key long, key2 long, spans binary")
    spans = spans.groupBy("key", "key2").agg(F.collect_list("spans").alias("spans"))
    whole = stated.join(spans, ["key", "key2"], "left")
    extra = ("__id", *[f"__{k}" for k in range(len(keep))])
    kinds = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in extra)
    out = whole.mapInArrow(_finish(buckets, extra, payload), f"{kinds}, {RESULT}")
    names = [c.split()[0] for c in RESULT.split(", ")]
    return out.select(F.col("__id").alias("id"), *[F.col(f"__{k}").alias(c) for k, c in enumerate(keep)], *names)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, payload=False).drop("kept").withColumnRenamed("id", "doc_id")
