"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib
import zlib

import pytest

from signet.llm import classifier, embedding_dedup, jaccard_join, licenses, mixing, packing, quality_rules, sharding, suffix_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, id string, e int, shared int"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
TEXTS = [
    (1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (None, "alpha beta gamma delta epsilon zeta"),
    (4, " \t\n "), (5, LONG), (6, LONG + " tail"), (7, "two words"), (8, "Two WORDS"), (9, "naïve café — “quotes” 日本語 <|endoftext|> don't"), (None, None),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if k % 3 == 0 else f"s{k % 2}", 0, 5, "k", "x", 1, 2) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def test_sharding(docs, none):
    rows = sharding.shard(docs, 3).collect()
    assert len(rows) == len(TEXTS)
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(3)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for r in rows:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.shard(none).count() == 0
    assert [r.shard for r in sorted(rows, key=str)] == [r.shard for r in sorted(sharding.shard(docs, 3).collect(), key=str)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 100, 1000])
def test_permutation(n):
    assert sorted(sharding.permute_int(x, n, 5) for x in range(n)) == list(range(n))


def test_permutation_columns(spark):
    n = 1000
    df = sharding.with_permutation(spark.range(n), "id", n, 9, "p")
    assert all(r.p == sharding.permute_int(r.id, n, 9) for r in df.collect())


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS)
    total, taken = {}, {}
    for r in rows:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 3 * r.size
        total[r.source] = total.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for r in rows:
        assert r.source_size == total[r.source] and abs(taken[r.source] - r.target) <= 1
    assert abs(sum({r.source: r.target for r in rows}.values()) - sum(total.values())) < 1e-6
    assert mixing.mix(none).count() == 0


def test_targets_water_filling(spark):
    s = spark.createDataFrame([("a", 1), ("b", 100), ("c", 1000), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(s, mixing.F.lit(1.0)).collect()}
    assert got["a"] == 3 and got["b"] == 300 and got["d"] == 0 and abs(got["c"] - 798) < 1e-9


def test_quality_rules(docs, none):
    rows = quality_rules.rules(docs).collect()
    assert len(rows) == len(TEXTS)
    assert sorted(r.n_words for r in rows) == sorted(len((t or "").split()) for _, t in TEXTS)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 10)
    assert quality_rules.rules(none).count() == 0


def test_line_frequency_rejects_depleted(spark):
    common = "this very common line stands in many documents of the host"
    rows = [(k, f"{common}\n{common} no {k}\nown words {k} a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k} i{k} j{k} k{k}") for k in range(60)] + [(100 + k, f"{common}\nshort {k}") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", quality_rules.F.lit("h"))
    got = {r.id: r for r in quality_rules.rules(df).collect()}
    assert all(got[k].kept for k in range(60)) is False or all(got[k].removed_words >= 11 for k in range(60))
    assert not any(got[100 + k].kept for k in range(5))


def test_licenses(docs, none, spark):
    assert len(licenses.scan(docs).collect()) == len(TEXTS)
    assert licenses.scan(none).count() == 0
    rows = [(1, "Released under the MIT License."), (2, "CC-BY cc by"), (3, None), (4, "Licensed under the Apache\nLicense, Version 2.0"), (5, "the mit")]
    got = {r.id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].score == 1.0 and got[4].labels == "apache-2.0"
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (2, 0, 2, "cc-by")
    assert (got[3].n_words, got[3].labels, got[3].first_word, got[3].score) == (0, "", None, 0.0)
    assert got[5].labels == "" and got[5].score < 0.8


def test_license_matches_and_chains():
    """Matching statistics, phrases and chains against brute force over all substrings and all chains."""
    import itertools
    import random

    import numpy as np

    rnd = random.Random(5)
    words = list("abcdef")
    for _ in range(60):
        templates = [(f"t{k}", " ".join(rnd.choice(words) for _ in range(rnd.randint(4, 12)))) for k in range(3)]
        phrases = (("a b", "ab"), ("c d e", "cde"))
        s = licenses.Scanner(templates, phrases, least=2, cover=0.6, gap=2)
        text = [rnd.choice([*words, "zz"]) for _ in range(30)]
        ids = np.array([s.index.get(w, -1) for w in text])
        places, found = s.scan(ids)
        assert sorted(places) == sorted((k, p) for p, (x, _) in enumerate(phrases) for k in range(len(text)) if text[k : k + len(x.split())] == x.split())
        whole = [t.split() for _, t in templates]
        inside = lambda x: any(t[k : k + len(x)] == x for t in [*whole, *[p.split() for p, _ in phrases]] for k in range(len(t)))  # noqa: E731, B023
        want = {}
        for a, b in itertools.combinations(range(len(text) + 1), 2):
            x = text[a:b]
            if len(x) >= 2 and inside(x) and not (a and inside(text[a - 1 : b])) and not (b < len(text) and inside(text[a : b + 1])):
                for t, seq in enumerate(whole):
                    for k in range(len(seq)):
                        if seq[k : k + len(x)] == x:
                            want.setdefault(t, []).append((a, k, len(x)))
        assert {t: sorted(m) for t, m in found.items()} == {t: sorted(m) for t, m in want.items()}
        for matches in found.values():
            matches = sorted(matches)

            def covered(chosen):
                total = chosen[0][2]
                for (x, y, m), (at, place, n) in itertools.pairwise(chosen):
                    new = n - max(0, x + m - at, y + m - place)
                    if x >= at or y >= place or at - x - m > 2 or place - y - m > 2 or new <= 0:
                        return 0
                    total += new
                return total

            if len(matches) <= 10:
                top = max(covered(c) for r in range(1, len(matches) + 1) for c in itertools.combinations(matches, r))
                assert max(c for c, _, _ in s.chain(matches)) == top


def test_license_whole_text_with_a_repeated_part(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining any person obtaining a copy of this software and associated documentation files"
    rows = [(1, text), (2, dict(licenses.LICENCES)["isc"].upper()), (3, "x " * 50 + dict(licenses.LICENCES)["zlib"] + " y")]
    got = {r.id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "mit" in got[1].labels.split(",") and got[1].score == 1.0
    assert got[2].labels == "isc" and got[3].labels == "zlib" and [(x.first, x.after) for x in got[3].spans if x.label == "zlib"] == [(50, got[3].n_words - 1)]


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs, packing.tokenizer_path()).collect()
    want = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in TEXTS)
    assert sum(r.length for r in rows) == want
    # every piece's ids, and the padded sequences, against the tokenizer
    own = {}
    for r in sorted(packing.pack(docs, packing.tokenizer_path(), payload=True).collect(), key=lambda r: r.start):
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) and r.length == len(r.ids)
        own.setdefault((r.id, r.doc_tokens), []).append(r.ids)
    full = [t.encode(x or "", add_special_tokens=False).ids + [1] for _, x in TEXTS]
    assert sorted(i for parts in own.values() for p in parts for i in p) == sorted(i for x in full for i in x)
    for (i, _), x in zip(TEXTS, full, strict=True):
        if i not in (1, None):
            assert [k for p in own[i, len(x)] for k in p] == x
    lines = packing.sequences(packing.pack(docs, packing.tokenizer_path(), payload=True)).collect()
    assert all(len(r.ids) == packing.SEQ for r in lines) and sum(r.n_tokens for r in lines) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 2048
    nine = t.encode(TEXTS[10][1], add_special_tokens=False).ids + [1]
    one = next(r for r in rows if r.id == 9)
    assert one.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in nine))
    assert packing.pack(none, packing.tokenizer_path()).count() == 0


def brute_repeats(rows):
    first = {}
    rank = lambda i: 2**63 - 1 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, 2**63), rank(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < rank(i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(docs, none, spark):
    got = suffix_dedup.remove_repeats(docs, keep=("lang", "key")).collect()
    assert sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_repeats(TEXTS)
    assert suffix_dedup.remove_repeats(none).count() == 0
    import random

    rnd = random.Random(4)
    bits = ["".join(rnd.choice("ab é") for _ in range(rnd.randint(20, 90))) for _ in range(12)]
    rows = [(k, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 7)))) for k in range(60)] + [(60, "be " * 900), (61, "x" + "be " * 400), (62, "be " * 20)]
    long = "".join(rnd.choice("abcdefghij ") for _ in range(1_200_000))
    rows += [(63, long), (64, long[:700_000] + "!" + long[700_000:])]  # longer than a piece
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows)
    for hot in (suffix_dedup.HOT, 1):  # 1: all anchors of several classes are split
        got = suffix_dedup.remove_repeats(df, hot=hot).collect()
        assert sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == want


def brute_components(rows):
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), i if not s else least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_jaccard(docs, none, spark):
    got = jaccard_join.join(docs).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(TEXTS)
    assert jaccard_join.join(none).count() == 0
    import random

    rnd = random.Random(2)
    rows = []
    for f in range(6):
        base = [f"f{f}w{rnd.randint(0, 400)}" for _ in range(rnd.choice([12, 60, 200]))]
        for _ in range(14):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 30))):
                w[rnd.randrange(len(w))] = f"m{rnd.randint(0, 9)}"
            rows.append((len(rows), " ".join(w)))
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_jaccard_bridges(spark):
    """Two texts linked only through a row without an id, and ids that bear several texts."""
    w = [f"w{k}" for k in range(100)]
    b, c = w[:45] + ["x1", "x2"] + w[45:], w[:45] + ["x1", "x2"] + w[45:90] + ["y1", "y2", "y3", "y4"] + w[90:]
    far = [f"z{k}" for k in range(60)]
    rows = [(1, " ".join(w)), (None, " ".join(b)), (7, " ".join(c)), (7, " ".join(far)), (9, " ".join([*far, "end"])), (None, "alone in the world of null ids"), (4, " ".join(w)), (7, " ".join(far))]
    want = brute_components(rows)
    assert sum(root == 1 for _, _, root in want) == 4  # 1, 4, the row without an id, and 7 through it
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.1], 0), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], None), (6, None, 0), (7, [0.0, 0.0], 0), (8, [nan, 1.0], 0), (9, [inf, 1.0], 0), (10, [1.0, None], 0), (11, [], 0), (12, [0.0, 1.0], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert got[None][:2] == (0, None)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_wide_vectors_and_repeated_ids(spark):
    """5,000 components, ids that bear several vectors, clashing column names, against all pairs."""
    import numpy as np

    rng = np.random.default_rng(3)
    a, c = rng.standard_normal(5000), rng.standard_normal(100)
    rows = [(1, a, 0), (2, a + 0.1 * rng.standard_normal(5000), 0), (3, c, 0), (3, c + 0.1 * rng.standard_normal(100), 0), (4, -a, 0), (5, 7 * c, 0), (3, c, 0)]
    df = spark.createDataFrame([(i, [float(x) for x in v], y, 1, "k") for i, v, y in rows], "vec_id long, embedding array<double>, label int, rep int, key string")
    unit = [v / np.linalg.norm(v) for _, v, _ in rows]
    linked = [[len(x) == len(y) and float(x @ y) >= 0.93 for y in unit] for x in unit]
    want = sorted((rows[k][0], sum(linked[k]) - 1) for k in range(len(rows)))
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted((r.id, r.n_links) for r in got) == want
    assert {r.id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}


def test_collision_recall():
    import numpy as np

    rnd = np.random.default_rng(0)
    x = rnd.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rnd.standard_normal((3000, 64))
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    y = 0.93 * x + (1 - 0.93**2) ** 0.5 * y
    half, least = embedding_dedup.window_and_count()
    line = embedding_dedup.lines_of(64)
    hit = (np.abs(x @ line - y @ line) <= half).sum(axis=1) >= least
    assert hit.mean() >= 0.995
    small = embedding_dedup.collisions(x[:50] @ line, y[:50] @ line, half)
    assert (small == (np.abs((x[:50] @ line)[:, None, :] - (y[:50] @ line)[None, :, :]) <= half).sum(axis=2)).all()


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "<p>" + "é" * 40000), (2, "http://b\r\nX: y", "<p>same"), (3, None, "<p>same"), (3, "http://c", "<p>same"), (4, "u", None), (5, "u", ""), (None, "n", "<p>only"), (2, "http://b", "<p>same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    files, root = warc.write_warc(df, f"file://{tmp_path}/warc", segment=1000)
    got = warc.read_warc(spark, files, root).collect()
    assert len(got) == len(rows) and not any(r.error for r in got)
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str)
    assert kinds == sorted([(1, "response", None), (2, "response", None), (2, "response", None), (3, "revisit", 2), (3, "revisit", 2), (4, "response", None), (5, "revisit", 4), (None, "response", None)], key=str)
    one = next(r for r in got if r.page_id == 1)
    assert bytes(one.payload).decode() == rows[0][2]
    assert warc.op4_sql() and warc.read_warc(spark, *warc.write_warc(df.limit(0))).count() == 0


def test_segments_that_do_not_fit():
    row = {"want_bytes": 3, "want_digest": warc.digest(b"abc")}
    warc.decode(row, warc.HTTP + warc.chunked(b"abc"), True)
    assert row["payload"] == b"abc" and "error" not in row
    bad = dict(want_bytes=3, want_digest=warc.digest(b"abc"))
    warc.decode(bad, warc.HTTP + b"5\r\nab\r\n0\r\n\r\n", True)
    assert bad["error"]


def test_classifier(spark, docs, none):
    good = [(100 + k, " ".join(f"word{(k * 7 + j) % 50} flows" for j in range(40))) for k in range(80)]
    bad = [(1000 + k, " ".join(f"JUNK{(k * 5 + j) % 50}###!!" for j in range(40))) for k in range(80)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(5000, None), (None, 1)], "doc_id long, quality int")
    df = spark.createDataFrame(good + bad + TEXTS, "doc_id long, text string")
    rows = classifier.classify(df, labels).collect()
    assert len(rows) == 160 + len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    held = {r.id: r for r in rows if r.held_out}
    right = [held[i].predicted == (i < 1000) for i in held if i >= 100]
    assert sum(right) / len(right) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows if r.id is not None)
    assert classifier.classify(none, labels).count() == 0
    flat = classifier.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in flat} == {0.5}
    assert classifier.fit(df, labels).keep(docs).columns == docs.columns
