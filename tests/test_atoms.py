"""Atoms of blocks: cuts by lines, frames, columns and sentences; places that cover the text."""

import random
import re
import statistics

from pyspark.sql import functions as F

from gatherum.operators import atoms as A

SCHEMA = "doc int, block string, text string, label string, frames array<int>, words array<array<struct<text: string, start: int, x0: double, x1: double>>>"


def words_of(line, at, gaps):
    """Words of a line with the given gaps between them, ten points each."""
    out, x = [], 0.0
    for k, m in enumerate(re.finditer(r"\S+", line)):
        x += gaps[k - 1] if k else 0.0
        out.append((m[0], at + m.start(), x, x + 10))
        x += 10
    return out


def block(doc, text, label="text", frames=(), gaps=None):
    at, words = 0, []
    for line in (text or "").split("\n"):
        n = len(re.findall(r"\S+", line))
        words.append(words_of(line, at, (gaps or {}).get(len(words), [5.0] * n)))
        at += len(line) + 1
    return (doc, "b", text, label, list(frames), words)


def cut(spark, *blocks, **more):
    rows = A.atoms(spark.createDataFrame(blocks, SCHEMA), "doc", "block", "text", "label", "frames", "words", **more)
    out = {}
    for r in rows.orderBy("doc", "start", "part").collect():
        out.setdefault(r["doc"], []).append((r["id"], r["cut"], r["text"], r["start"], r["stop"], r["frame"], None if r["cells"] is None else [tuple(c) for c in r["cells"]]))
    return out


def test_lines_frames_and_columns(spark):
    got = cut(
        spark, block(1, "  One line \n\n\t two"), block(2, "left side right side", gaps={0: [5.0, 40.0, 5.0]}), block(3, "12. hanging indent", gaps={0: [40.0, 5.0]}), block(4, "a b c d", gaps={0: [17.0, 18.0, 5.0]}),
        block(5, "one two three four", gaps={0: [30.0, 30.0, 30.0]}), block(6, "end of page begin of next", frames=[0, 12]), block(7, "x y z w", frames=[2], gaps={0: [5.0, 5.0, 50.0]}), block(8, None), block(9, " \n "), block(10, "only wide", gaps={0: [19.0]}),
    )
    brief = {k: [(x[0], x[1], x[2]) for x in v] for k, v in got.items()}
    assert brief[1] == [("b.1", None, "One line"), ("b.3", None, "two")] and got[1][0][3:5] == (2, 10)
    assert brief[2] == [("b.1.1", "column", "left side"), ("b.1.2", "column", "right side")]
    assert brief[3] == [("b.1", None, "12. hanging indent")] and brief[4] == [("b.1", None, "a b c d")] and brief[5] == [("b.1", None, "one two three four")]
    assert brief[6] == [("b.1.1", "frame", "end of page"), ("b.1.2", "frame", "begin of next")] and [x[5] for x in got[6]] == [0, 1]
    assert brief[7] == [("b.1.1", "frame_column", "x"), ("b.1.2", "frame_column", "y z"), ("b.1.3", "frame_column", "w")]
    assert brief[8] == brief[9] == [("b.1", None, "")] and brief[10] == [("b.1.1", "column", "only"), ("b.1.2", "column", "wide")]


def test_sentences_and_tables(spark):
    long = "Dies ist ein Satz von Dr. Meier. " * 7 + "Am 3. Mai endet es."
    got = cut(spark, block(1, long), block(2, long, "table"), block(3, "Kurz. Und gut."), block(4, "Es ist aus.Nun folgt mehr."), block(5, "a\tb c\t\n \td", "table"), block(6, "x" * 300), long=200)
    assert len(got[1]) == 8 and {x[1] for x in got[1]} == {"sentence"} and got[1][-1][2] == "Am 3. Mai endet es."
    assert len(got[2]) == len(got[3]) == len(got[6]) == 1
    assert [(x[1], x[2]) for x in got[4]] == [("sentence_no_space", "Es ist aus."), ("sentence_no_space", "Nun folgt mehr.")]
    assert [x[6] for x in got[5]] == [[(0, 1), (2, 5)], [(9, 10)]]


def test_atoms_cover_the_text(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["wort", " ", "  ", "\n", "\t", ". ", ".", "Der ", "é", "😀", "1. "]) for _ in range(rng.randrange(200))) for _ in range(60)]
    blocks = [block(k, t, rng.choice(["text", "table"]), sorted(rng.sample(range(len(t) + 1), min(2, len(t)))), {j: [rng.choice([4.0, 5.0, 60.0]) for _ in range(200)] for j in range(100)}) for k, t in enumerate(texts)]
    for k, found in cut(spark, *blocks, long=40).items():
        t = texts[k]
        assert all(t[a:b] == own and own.strip() == own for _, _, own, a, b, _, _ in found)
        assert all(x[4] <= y[3] for x, y in zip(found, found[1:]))
        assert "".join("".join(x[2].split()) for x in found) == "".join(t.split())


def test_median_of_the_others(spark):
    rng = random.Random(1)
    rows = [([float(rng.randrange(5)) for _ in range(rng.randrange(1, 8))],) for _ in range(100)]
    df = spark.createDataFrame(rows, "v array<double>").withColumn("o", F.array_sort("v")).select("v", F.transform("v", lambda x: A.median_of_others(F.col("o"), x)).alias("m"))
    for v, m in df.collect():
        assert m == [statistics.median(v[:k] + v[k + 1 :]) if len(v) > 1 else None for k in range(len(v))]
