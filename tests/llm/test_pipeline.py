"""The pipeline's stages against brute force, each on what the one before it kept."""

import hashlib
import os

import pytest

from .test_edges import brute_components, brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark):
    import corpus_pipeline as c
    from signet.llm import classifier, packing
    from signet.llm.common import Table
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 120")
    kept = [docs]
    for name, stage in c.STAGES:
        kept.append(Table(stage(spark, kept[-1], SF), f"test-{name}").df)
    assert all(d.columns == list(c.COLUMNS) for d in kept[1:-1])
    rows = [[tuple(r) for r in d.select("doc_id", "text").collect()] for d in kept[:-1]]
    # 1: what the model scores 0.5 or more
    model = classifier.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.id for r in model.score(docs).filter("score >= 0.5").collect()}
    assert {i for i, _ in rows[1]} == good and len(good) > 80
    # 2: the smallest id of each component
    assert {i for i, _ in rows[2]} == {root for _, _, root in brute_components(rows[1])}
    # 3: texts without repeated passages
    want = {i: (n, gone, sha) for i, n, gone, _, sha in brute_repeats(rows[2])}
    got = dict(rows[3])
    assert set(got) == {i for i, (n, gone, _) in want.items() if gone < n or n == 0}
    assert all(hashlib.sha256(t.encode()).hexdigest() == want[i][2] for i, t in got.items() if want[i][1] == 0)
    # 4: copies follow the targets within half of a source's longest document
    from collections import Counter

    times, source = Counter(i for i, _ in rows[4]), {r.doc_id: r.source for r in kept[3].collect()}
    size = {i: len(t.split()) for i, t in got.items()}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    order = sorted(total)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, full, rest = {}, set(), float(sum(total.values()))
    while True:
        free = [s for s in order if s not in full]
        level = (rest - sum(3 * total[s] for s in full)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    for s in order:
        target[s] = 3 * total[s] if s in full else level * weight[s]
        taken = sum(times[i] * size[i] for i in size if source[i] == s)
        assert abs(taken - target[s]) <= max(size[i] for i in size if source[i] == s) / 2 + 1
    assert max(times.values()) <= 3
    # 5: every token of every copy in one place
    t = Tokenizer.from_file(packing.tokenizer_path())
    pieces = kept[5].collect()
    assert sum(r.length for r in pieces) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in rows[4])
    assert max(r.offset + r.length for r in pieces) <= 2048
