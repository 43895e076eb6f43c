"""Importance resampling against the definition, row by row."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from gatherum.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score string, rank long, n_words long"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text):
    words = WORD.findall(lowered(text))
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)


def plain(docs, target):
    own, theirs = Counter(), Counter()
    for _, t in docs:
        own.update(features(t)[0])
    for t in target:
        theirs.update(features(t)[0])
    s_all, t_all = sum(own.values()), sum(theirs.values())
    gain = lambda b: math.floor(1000 * math.log((theirs[b] + 1.0) * (s_all + 10000.0) / ((own[b] + 1.0) * (t_all + 10000.0))))
    rows = []
    for doc_id, text in docs:
        found, n_words = features(text)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = Counter()
    out = []
    for rank, r in enumerate(able, 1):
        drawn[r] += 1
        out.append((*r[:4], rank if rank <= 5 * len(able) // 100 else None))
    return out + [(*r[:4], None) for r in rows if r[4] < 20]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def check(spark, docs, target):
    frame = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in docs], SCHEMA).withColumn("a.b", F.lit(1))
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(frame, goal)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, target), key=key)


def test_against_the_definition(spark):
    rng = random.Random(2)
    vocabulary = [rng.choice("abcdeABCDE") + "x" * rng.randrange(5) + str(k) for k in range(60)] + ["É", "中文", "naïve😀", "w" * 70, "v" * 500]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-\n", "\x00", "_"]) for _ in range(n))
    docs = [(k, text(rng.randrange(1, 60))) for k in range(400)]
    docs += [(500, None), (501, ""), (502, " .-"), (503, "one"), (504, "one two"), (505, text(30_000)), (None, text(25)), (None, text(25))]
    docs += [docs[3], docs[3], (3, text(40)), (-7, docs[5][1])]
    check(spark, docs, [text(40) for _ in range(10)] + [None, ""])


def test_empty_tables(spark):
    check(spark, [], ["a b"])
    check(spark, [(1, "a b c " * 10), (2, None)], [])
    check(spark, [(k, "word " * 25) for k in range(50)], ["word"])


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(k, 20, 57, 0, 100_000 * (k % 3)) for k in range(90)], "doc_id long, n_words long, n_features long, weight long, score long")
    got, cutoff = resampling.numbered(rows, 40)
    ranks = {r.doc_id: r["rank"] for r in got.collect()}
    assert cutoff == 100_000 and len(ranks) == 60
    assert [k for k, _ in sorted(ranks.items(), key=lambda x: x[1])] == [*range(2, 90, 3), *range(1, 90, 3)] and sorted(ranks.values()) == list(range(1, 61))


def test_crc_of_joined_words():
    import numpy as np

    words = [b"a", b"word", b"x" * 63, b"y" * 64, b"z" * 100_000]
    left = np.array([zlib.crc32(a) for a in words for _ in words], dtype=np.uint32)
    right = np.array([zlib.crc32(b) for _ in words for b in words], dtype=np.uint32)
    length = np.array([len(b) for _ in words for b in words])
    assert resampling.joined_crc(left, right, length).tolist() == [zlib.crc32(a + b" " + b) for a in words for b in words]
    short = length < 64
    assert resampling.joined_crc(left[short], right[short], length[short]).tolist() == [zlib.crc32(a + b" " + b) for a in words for b in words if len(b) < 64]
