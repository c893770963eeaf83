"""What the removal of repeated passages spends on arrays and memory, and that its arrays find what brute force finds."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from signet.llm import suffix_dedup as S


def _table(texts, same=None):
    """The segments of some texts as rows for the arrays; same: a number for all anchors, as if their hashes met."""
    data, offsets = S.W.buffers(pa.array(texts))
    rows = []
    for i, a, b, h, _, place in zip(*S.segments(data, offsets), strict=True):
        rows.append((int(h) if same is None else same, int(i), 0, int(i), int(a - offsets[i]), int(place - a) if place >= 0 else -1, data[a:b].tobytes()))
    names = ("anchor", "key", "key2", "rank", "at", "anchor_at", "bytes")
    return pa.table({n: pa.array([r[k] for r in rows], pa.binary() if n == "bytes" else pa.int64()) for k, n in enumerate(names)})


def _covered(out):
    found = {}
    for key, raw in zip(out.column("key").to_pylist(), out.column("spans").to_pylist(), strict=True):
        for a, b in np.frombuffer(raw, np.int64).reshape(-1, 2).tolist():
            found.setdefault(key, set()).update(range(a, b))
    return found


def _brute(texts):
    first, found = {}, {}
    for i, t in enumerate(texts):
        for a in range(len(t) - S.SPAN + 1):
            if first.setdefault(t[a : a + S.SPAN], i) < i:
                found.setdefault(i, set()).update(range(a, a + S.SPAN))
    return found


def _passages(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 9)))
    shared = [" ".join(word() for _ in range(rnd.randint(3, 40))) for _ in range(12)] + ["be " * 60, "x" * 90, "-=" * 45]
    return [" ".join(rnd.choice(shared) if rnd.random() < 0.6 else word() for _ in range(rnd.randint(1, 8))) for _ in range(60)]


@pytest.mark.parametrize("same", [None, 7])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_arrays_equal_brute_force(seed, same):
    texts = _passages(seed)
    out = S._arrays(_table(texts, same))
    assert _covered(out) == _brute(texts)
    assert len(set(out.column("key").to_pylist())) == len(out)  # one row for a text


def _joined(monkeypatch, texts):
    sizes = []
    real = S.suffix_array
    monkeypatch.setattr(S, "suffix_array", lambda t: sizes.append(len(t)) or real(t))
    assert _covered(S._arrays(_table(texts))) == _brute(texts)
    return sum(sizes)


def test_no_array_for_a_part_alone(monkeypatch):
    rnd = random.Random(5)
    other = lambda n: "".join(rnd.choice("abcdefghijkl") for _ in range(n))
    passage = other(400)
    # two texts share a passage: of each anchor there is one clipped part, which its ranks decide
    assert _joined(monkeypatch, [other(200) + passage + other(200), other(300) + passage + other(100)]) == 0


def test_anchors_are_one_byte_in_arrays(monkeypatch):
    rnd = random.Random(6)
    passage = "".join(rnd.choice("abcdefghijkl") for _ in range(400))
    texts = [passage[k : 400 - k % 7] for k in range(0, 120, 5)]
    parts = {(r["anchor"], r["bytes"]) for r in _table(texts).to_pylist()}
    assert 0 < _joined(monkeypatch, texts) <= sum(len(b) - S.GRAM + 2 for _, b in parts)


def test_segments_hold_little():
    rnd = random.Random(4)
    data, offsets = S.W.buffers(pa.array(["".join(rnd.choices("abcdefgh ", k=20_000)) for _ in range(100)]))
    S.segments(data, offsets)  # powers are kept
    tracemalloc.start()
    S.segments(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(data)
