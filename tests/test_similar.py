import random
from difflib import SequenceMatcher

import pytest

from gatherum.functions import text as T
from gatherum.operators import joins as J


def test_lines_are_those_of_exhaustive_comparison(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcde fgh") for _ in range(rng.randrange(3, 60))) for _ in range(12)] + ["aaaaaaaaaaaa", "ababababab", "kanton bern", "kantom bern", "x"]

    def edited(t):
        t = list(t)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randrange(2)] = rng.choice(["", "z", "q"])
        return "".join(t)

    rows = [(d, p, k, edited(rng.choice(base)) + rng.choice(["", " 1", " 12"]), float(rng.randrange(0, 120, 7))) for d in range(3) for p in range(4) for k in range(12)]
    df = spark.createDataFrame(rows, "doc int, page int, line int, text string, top double")
    letters, digits = T.furniture_key(df["text"])
    keyed = [tuple(r) for r in df.select("doc", "page", "line", "top", letters, digits).collect()]
    want = {a[:3] for a in keyed for b in keyed if a[4] and b[4] and a[0] == b[0] and a[1] != b[1] and len(a[5]) == len(b[5]) and abs(a[3] - b[3]) <= 30 and SequenceMatcher(None, a[4], b[4]).ratio() >= 0.9}
    got = [(r["doc"], r["page"], r["line"]) for r in J.similar_lines(df, "doc", "page", "line", "text", "top").collect()]
    assert set(got) == want and len(want) > 20 and len({k for k in keyed if k[:3] not in want and k[4]}) > 5


def test_a_filter_that_is_not_sure_is_refused(spark):
    with pytest.raises(ValueError):
        J.similar_texts(spark.createDataFrame([("a", "b")], "g string, t string"), ["g"], "t", least=0.5)


def test_large_and_small_groups_give_the_same_pairs(spark):
    """Both ways equal the comparison of all; no exchange by gram holds a text."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 50))) for _ in range(6)]
    texts = {(g, t[:k] + x + t[k + cut :]) for g in range(3) for t in base for k in (0, len(t) // 2, len(t)) for x, cut in (("", 0), ("z", 0), ("q", 1))}
    df = spark.createDataFrame(sorted(texts), "g int, t string")
    want = {(g, a, b) for g, a in texts for h, b in texts if g == h and SequenceMatcher(None, a, b).ratio() >= 0.9}
    for paired in (0, 20, 100):
        found = J.similar_texts(df, ["g"], "t", paired=paired)
        assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > len(texts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [row for row in plan.splitlines() if "Aggregate" in row and "_gram" in row and "_t#" in row]
