"""How much the removal of repeated passages deals, and that few-windowed forms of its steps find the same."""

import random
import time

import numpy as np
import pyarrow as pa

from signet.llm import suffix_dedup as S

from .test_edges import brute_repeats


def _texts(n, seed=7):
    rnd = random.Random(seed)
    return [(k, " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 3) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(20, 400)))) for k in range(n)]


def _plan(df):
    """The plan that ran, without the list of what it was made from."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_text_is_dealt_once(spark):
    rows = _texts(60)
    df = spark.createDataFrame([(i, t + rows[(i + 1) % 60][1], "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for keep in ((), ("lang", "source")):
            plan = _plan(S.remove_repeats(df, keep=keep))
            # the rows are read for one exchange, and what needs them again has that one
            assert plan.count("Scan ExistingRDD") == 1 and "ReusedExchange" in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_blobs_do_not_grow_with_the_buckets():
    texts = [t for _, t in _texts(300)]
    text, _, _, h, g, _ = S.segments(*S.W.buffers(pa.array(texts)))
    held = [(np.arange(2 * len(texts)).reshape(-1, 2), np.arange(len(texts)) * 7919 % 5_000_000, text, h, g)]
    for buckets in (8, 512):
        rows = list(S._blobs(held, buckets, 0))
        n = sum(len(x) for r in rows for x in r[2:] if x is not None)
        assert n < 18 * len(text) + 16 * len(texts) + 40 * len(rows)
        back = np.concatenate([np.repeat(np.cumsum(S._widen(r[2])), S._widen(r[4])) for r in rows if r[0] >= 0])
        assert sorted(back.tolist()) == text.tolist()


def test_narrow():
    for x in ([0], [5, 5], [-3, 1 << 62, 9223372036854775807], [-9223372036854775808, 9223372036854775807], [1, 256, 70_000]):
        assert S._widen(S._narrow(np.array(x, np.int64))).tolist() == x


def test_ranges_cover_each_window_once():
    rnd = random.Random(3)
    for raw in ("be " * 60, "".join(rnd.choice("abcdef ") for _ in range(3_000)), "x" * 90):
        data = raw.encode()
        _, start, end, _, _, place = S.segments(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        seen, names = [], {}
        for a, b, p in zip(start, end, place, strict=True):
            rows = list(S.ranges(data[a:b], int(p - a) if p >= 0 else -1))
            for name, lo, hi, at in rows:
                assert lo <= at and at + S.GRAM <= hi
                for w in range(lo, hi - S.SPAN + 1):
                    seen.append(int(a) + w)
                    assert names.setdefault(data[a + w : a + w + S.SPAN], name) == name  # equal windows meet
            if p >= 0:
                assert len(rows) <= len(S.RANGES)
        assert sorted(seen) == list(range(len(data) - S.SPAN + 1))


def test_rows_twice(spark):
    rows = _texts(30) + [(40, _texts(1)[0][1][:300])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for hot in (S.HOT, 1):
        got = S.remove_repeats(df.union(df), hot=hot).collect()
        assert sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute_repeats(rows + rows)


def test_shuffle_files_go_with_their_table(spark):
    import os

    from pyspark.sql import functions as F
    from signet.llm.common import Table

    folders = [d.getAbsolutePath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {n for d in folders for _, _, names in os.walk(d) for n in names if n.startswith("shuffle_")}
    before = files()
    t = Table(spark.range(1000).repartition(3, F.col("id") % 7).groupBy((F.col("id") % 10).alias("k")).count(), "t")
    left = files() - before
    for _ in range(50):  # they go in the background
        left = {n for n in left if n in files()}
        if not left:
            break
        time.sleep(0.1)
    assert not left and t.df.count() == 10
