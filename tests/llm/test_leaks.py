"""Benchmark leaks against exhaustive alignment of every text with every item."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherum.llm import decontaminate as D


def pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def exhaustive(texts, items):
    """All pairs at the threshold; a pair with too few words in common can't reach it."""
    bodies, wanted = [D.numbered(t) for t in texts], [D.numbered(t) for t in items]
    out = set()
    for d, body in enumerate(bodies):
        for i, item in enumerate(wanted):
            if len(item) and len(body) and D.in_common(item, body) >= D.THRESHOLD * len(item) and D.align(item, body)[0] >= D.THRESHOLD * D.MATCH * len(item):
                out.add((d, i))
    return out


def tables(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_wide_alignments_short_items_and_scripts_without_spaces(spark):
    item = [f"w{k}" for k in range(100)]
    spread = item[:3] + [x for k, w in enumerate(item[3:]) for x in ([w, f"foreign{k}"] if k < 78 else [w])]
    items = [" ".join(item), "only two", "single", "中文字符很多", ""]
    texts = [" ".join(spread), "well, it is ONLY two, you see", "one Single word", "这里有中文字符很多的例子", "only, two", "nothing here", None, "", "two only"]
    docs, bench = tables(spark, texts, items)
    got = {(r["doc_id"], r["item_id"]): r for r in D.leaks(docs, bench).collect()}
    assert set(got) == exhaustive(texts, items) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 1)}
    assert got[0, 0]["score"] == 0.61 and (got[0, 0]["word_start"], got[0, 0]["word_end"]) == (0, 178)
    assert (got[3, 3]["word_start"], got[3, 3]["word_end"]) == (3, 9)
    assert D.reach(100, 0.6) == 180
    assert pairs(D.leaks(docs, bench.where("item_id = 4"))) == set()


def test_numbers_are_those_of_the_words():
    texts = ["", None, "a", "Ein Wort, ein WORT; ein_wort x2", "中文 字符abc中", "ΣΊΣΥΦΟΣ İstanbul ﬁn ß", "e\u0301 ไทย \U00020000\U00020001 \ud800", " \n", "x" * 5000 + " y"]
    codes, stops = D.numbered_all(texts)
    per_text = [codes[a:b] for a, b in zip([0, *stops], stops)]
    seen = {}
    for t, found in zip(texts, per_text):
        assert len(found) == len(D.words(t)) and np.array_equal(found, D.numbered(t))
        for w, c in zip(D.words(t), found.tolist()):
            assert seen.setdefault(w, c) == c
    assert len(set(seen.values())) == len(seen)


def edited(rng, words, vocabulary, edits):
    out = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(vocabulary)
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice(vocabulary))
    return out


@pytest.fixture(scope="module")
def hard():
    """1,000 texts over few words, so that n-grams are frequent, with copies of which up to a third of the words are edited."""
    rng = random.Random(31)
    vocabulary = [f"v{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    noise = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [noise(rng.randrange(12, 30)) for _ in range(8)]
    texts = []
    for k in range(1000):
        body = noise(rng.randrange(20, 80))
        if k % 4 == 0:
            item = items[0] if k % 8 == 0 else rng.choice(items)  # one item is in an eighth of all texts
            body[len(body) // 2 : len(body) // 2] = edited(rng, item, vocabulary, rng.randrange(0, len(item) // 3 + 1))
        texts.append(" ".join(body))
    items = [" ".join(x) for x in items]
    return texts, items, exhaustive(texts, items)


def test_recall_where_ngrams_are_frequent(spark, hard):
    texts, items, want = hard
    docs, bench = tables(spark, texts, items)
    got = pairs(D.leaks(docs, bench))
    print(f"leaks: {len(got & want)} of {len(want)} found by rare seeds")
    assert got <= want and len(got) >= 0.9 * len(want)
    every = pairs(D.leaks(docs, bench, rare_share=1.0))
    assert got <= every <= want and len(every) >= 0.99 * len(want)
    kept = {r["doc_id"] for r in D.drop_leaks(docs, bench).collect()}
    assert kept == set(range(1000)) - {d for d, _ in got}


def test_filter_loses_nothing(spark):
    rng = np.random.default_rng(3)
    known = np.unique(rng.integers(0, 1 << 60, 5000, dtype=np.uint64))
    grams = spark.createDataFrame([(int(x), 1) for x in D.codes(known, 1).view(np.int64)], "code long, size int")
    f = D.make_filter(grams)
    code = D.codes(known, 1)
    assert (f._set(code & f.mask) & f._set(code >> np.uint64(32) & f.mask)).all()
    other = D.codes(rng.integers(0, 1 << 60, 200_000, dtype=np.uint64), 1)
    assert (f._set(other & f.mask) & f._set(other >> np.uint64(32) & f.mask)).mean() < 1e-4


def test_awkward_tables(spark):
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(1, item, "a", 1), (1, item, "a", 1), (None, "x " + item, None, 2), (2, None, "b", 3), (3, "", "c", None), (4, "z " * 50_000 + item, "d", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `k1` string, `item.id` long")
    bench = spark.createDataFrame([(7, item, 1), (7, item, 2), (None, item, 3)], "item_id long, text string, doc_id long")
    found = D.leaks(docs, bench).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["score"]) for r in found) == [("1", 7, 1.0), ("1", 7, 1.0), ("4", 7, 1.0), ("None", 7, 1.0)]
    kept = D.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 3}
    empty = docs.limit(0)
    assert D.leaks(empty, bench).count() == 0 and D.drop_leaks(empty, bench).count() == 0 and D.drop_leaks(docs, bench.limit(0)).count() == 6
    assert D.leaks(docs.withColumn("seeds", F.lit(1)), bench).columns == ["doc_id", "item_id", "score", "word_start", "word_end", "seeds"]
