"""Removal of repeats against the definition, window by window."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherum.llm import suffixes

SCHEMA = "doc_id long, text string, doc string, first long, kept string"


def plain(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text)."""
    first = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        if i is not None:
            for s in range(len(raw) - 49):
                w = raw[s : s + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for s in range(len(raw) - 49):
            if i is not None and first[raw[s : s + 50]] < i:
                gone[s : s + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def check(spark, rows, batches=4):
    frame = spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], SCHEMA).withColumn("a.b", F.lit(1))
    got = suffixes.remove_repeats(frame, batches=batches)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)
    assert not spark.catalog.listTables() or all(not t.name.startswith("gatherum_") for t in spark.catalog.listTables())


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(200)] + ["中文", "é", "😀"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(rng.randrange(8, 40)) for _ in range(8)] + ["x" * 49, "y" * 50, "z" * 51, "ab" * 200, "q" * 900]
    rows = []
    for k in range(n):
        parts = [text(rng.randrange(0, 40))]
        for _ in range(rng.randrange(4)):
            whole = rng.choice(passages)
            a = rng.randrange(len(whole)) if rng.random() < 0.5 else 0
            parts += [whole[a : a + rng.randrange(40, 400)], text(rng.randrange(0, 6))]
        rows.append((k * 7 % 101 if k % 9 else k, rng.choice(["", " "]).join(parts)))
    rows += [(300 + k, rows[k][1]) for k in range(20)] + [(400 + k, rows[k][1][3:-5]) for k in range(20)] + [(500 + k, text(3).join([rows[k][1]] * 2)) for k in range(10)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_definition(spark, seed):
    check(spark, corpus(seed))


def test_awkward_rows(spark):
    long = "".join(random.Random(3).choice("abcdefghijklmnop ") for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (5, long), (5, long), (5, long[100:200] + "!" * 60), (4, long[:500] + "?"), (None, long), (None, long[:300]), (-3, long[200:290]), (9, "-" * 5_000), (8, "-" * 60), (10, long[:49] + "#" + long[49:100]), (11, "é" * 40), (12, "é" * 26)]
    check(spark, rows)
    check(spark, rows, batches=1)
    check(spark, [(7, long[:200])] * 5)
    check(spark, [])
    check(spark, [(1, None), (2, "x")])


def test_many_batches_leave_few_levels(spark):
    rows = [(k, t) for k, (_, t) in enumerate(corpus(4, 60))]
    check(spark, rows, batches=9)
    tables = suffixes._Tables(spark)
    family = suffixes.SuffixFamily(tables)
    sizes = []
    for k in range(7):
        family.add(spark.createDataFrame([(k, f"{k} text that is long enough for a window of bytes, {k} times".encode())], "doc long, text binary"))
        sizes.append([size for size, _ in family.levels])
    tables.drop(*[t for _, t in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]


def test_blocks_don_t_cut_matches(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_BLOCK", 130)
    texts = [t.encode() for _, t in corpus(5, 40)]
    data, bounds = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0] + [len(t) for t in texts])
    windows = set()
    for start, count, at, text, *_ in suffixes.window_runs(data, bounds):
        for s, n, p, k in zip(start.tolist(), count.tolist(), at.tolist(), text.tolist()):
            assert all(s + j <= p <= s + j + 34 for j in range(n))
            windows |= {(k, s + j - bounds[k]) for j in range(n)}
    assert windows == {(k, s) for k, t in enumerate(texts) for s in range(len(t) - 49)}


def test_spans_touch_and_overlap():
    a, b = suffixes.kept_spans(np.array([0, 50, 101, 120, 300]), 400)
    assert a.tolist() == [0, 101, 300] and b.tolist() == [100, 170, 350]


def test_buckets_are_joined_and_grouped_as_they_were_sorted(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("hi"), (F.col("id") % 7).alias("lo"), F.col("id").alias("doc"))
    tables = suffixes._Tables(spark)
    try:
        a, b = (tables.write(rows.repartition(tables.buckets, "hi", "lo"), "test-buckets", "hi", "lo") for _ in range(2))
        with suffixes._own_shuffles(spark):
            got = a.groupBy("hi", "lo").agg(F.min("doc").alias("first")).join(b.hint("merge"), ["hi", "lo"])
            plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Sort [" not in plan and "HashAggregate" not in plan and "Exchange" not in plan
        assert got.where("first = doc").count() == 1000
    finally:
        tables.close()
