import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatherum.functions import dates as D
from gatherum.functions import text as T
from gatherum.operators import joins as J
from gatherum.operators import measure as M
from gatherum.operators import models as L
from gatherum.operators import profile as P
from gatherum.operators import sequence as Q


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("text,folded", [("Größe, ÉTÉ", "grosse ete"), ("", ""), ("--", ""), ("a­b", "ab"), ("Ⅻ x", "xii x")])
def test_fold(text, folded):
    assert T.fold_value(text) == folded


def test_fold_forms_agree_on_latin(spark):
    words = ["Größe", "ÉTÉ à l'école", "Straße 12", "ñandú", "", "x--y"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(T.fold_latin(F.col("w")).alias("a"), T.fold("w").alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_search_form_offsets(s):
    form, at = T.search_form(s)
    assert len(form) == len(at) and at == sorted(at) and all(0 <= i < len(s) for i in at)


@pytest.mark.parametrize("text,days", [
    ("Am 9. September 2013", ["2013-09-09"]), ("1er mars 2021", ["2021-03-01"]), ("20 dicembre 2019", ["2019-12-20"]), ("12.3.98", ["1998-03-12"]), ("12.3.39", ["2039-03-12"]),
    ("12-3-98", []), ("2020-02-30", []), ("2020-02-29", ["2020-02-29"]), ("1.1.1700", []), ("31.12.2099", ["2099-12-31"]), ("", []),
])
def test_find_dates(spark, text, days):
    hits = one(spark, D.find_dates(F.lit(text)))
    assert [h["day"] for h in hits] == days
    assert all(text[h["start"] : h["stop"]] for h in hits)


def test_places_of_dates(spark):
    text = "ä 1. März 2020; 3/4/21, fe\u0301vrier 12 f\u00e9vrier 2019, 5.\u00a0Ja\u00adnuar 1999 und 2001-02-30, 2001-02-28; 12.13.2020, 10.11.12.2020, 1er\nao\u00fbt 2018 7 Mai2000"
    hits = one(spark, D.find_dates(F.lit(text)))
    assert [(h["day"], text[h["start"] : h["stop"]], h["form"]) for h in hits] == [
        ("2020-03-01", "1. März 2020", "month_name"), ("2021-04-03", "3/4/21", "numeric"), ("2019-02-12", "12 février 2019", "month_name"), ("1999-01-05", "5.\u00a0Ja\u00adnuar 1999", "month_name"),
        ("2001-02-28", "2001-02-28", "iso"), ("2018-08-01", "1er\naoût 2018", "month_name"),
    ]


def test_search_forms_character_by_character():
    def plain(s):
        out, at = [], []
        for i, c in enumerate(s):
            for x in map(chr, T._searched_as(ord(c))):
                if x != " " or not out or out[-1] != " ":
                    out.append(x)
                    at.append(i)
        return "".join(out), at

    texts = ["", "Über  die\n\tStraße", "e\u0301\u00ad x", "\u00ad\u00ad", "ﬁn  ½ “a”", "𝔘 \u2009 b"]
    for t, (form, at) in zip(texts, T.search_forms(texts)):
        assert (form, at.tolist()) == plain(t)
    assert T.search_form("Über  die Straße") == ("uber die strasse", [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 14, 15])


def test_percent_encode(spark):
    from urllib.parse import quote

    for t in ("a b+c*d~e-_.", "ä/?&=%", "日本 \n", ""):
        assert one(spark, T.percent_encode(F.lit(t))) == quote(t, safe="-._~")


def test_sentences_without_space(spark):
    cut = lambda t: one(spark, T.sentences_without_space(F.lit(t)))
    assert cut("Es ist zu Ende.Am Tag danach. Es ging") == ["Es ist zu Ende.", "Am Tag danach. Es ging"]
    assert cut("Name-St.Gallen und www.Seite.Am/x, Dr.Muster") == ["Name-St.Gallen und www.Seite.Am/x, Dr.Muster"]
    assert cut("Frage?Antwort!Ja") == ["Frage?", "Antwort!", "Ja"] and cut("") == []


def test_lines_of_long_texts(spark):
    from gatherum.operators import sequence as S

    for n in (1, 3, 511, 512, 513, 1025, 3000):
        text = "\n".join("x" * (k % 7) for k in range(n))
        got = [(r["line"], r["text"], r["start"], r["stop"]) for r in S.lines(spark.createDataFrame([(1, text)], "d int, t string"), "d", "t").collect()]
        want, at = [], 0
        for k, line in enumerate(text.split("\n")):
            want.append((k, line, at, at + len(line)))
            at += len(line) + 1
        assert sorted(got) == want
    assert "Exchange" not in S.lines(spark.createDataFrame([(1, "a")], "d int, t string"), "d", "t")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("value,day,reason", [("2020-01-05T10:00", "2020-01-05", None), ("1900-01-01", None, "day_1900"), ("", None, "empty"), (None, None, "empty"), ("2020-02-30", None, "bad_form"), ("5.1.2020", None, "bad_form")])
def test_register_day(spark, value, day, reason):
    v = F.lit(value).cast("string")
    assert one(spark, D.register_day(v).cast("string")) == day and one(spark, D.register_day_reason(v)) == reason


def test_titles_and_numbers(spark):
    assert one(spark, T.titles_equal(F.lit("Ein neuer Titel für alle"), F.lit("ein neuer titel fur ALLE")))
    assert not one(spark, T.titles_equal(F.lit("--"), F.lit("--")))
    assert one(spark, T.number_runs(F.lit("M 007/2020"))) == ["m", "7", "2020"]
    assert one(spark, T.number_runs(F.lit("000"))) == ["0"] and one(spark, T.number_runs(F.lit("-"))) is None
    assert [one(spark, T.number_class(F.lit(x))) for x in ("12345678", "abcdef01", "1234", "12345")] == ["S1", "S2", None, "S1"]
    assert one(spark, T.is_part(F.array(F.lit("b"), F.lit("c")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    assert one(spark, T.contract_spaced(F.lit("M U N I C I P I O"))) == "MUNICIPIO"
    assert one(spark, T.sentences(F.lit("Dr. Muster kam. Er ging am 3. Mai. Ende!"))) == ["Dr. Muster kam.", "Er ging am 3. Mai.", "Ende!"]
    assert T.join_hyphenated(["Gemein-", "derat und", "Kirchen-", "gemeinde"], {"gemeinderat"}) == "Gemeinderat und Kirchen-gemeinde"


def test_beta_quantile_inverts():
    for a, b, q in ((0.5, 3.5, 0.05), (13.5, 1.5, 0.95), (100.5, 0.5, 0.5)):
        assert abs(M.incomplete_beta(a, b, M.beta_quantile(a, b, q)) - q) < 1e-9
    assert abs(M.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-12


@given(st.integers(2, 5), st.integers(1, 7), st.integers(0, 10_000))
@settings(max_examples=40, deadline=None)
def test_viterbi_against_all_paths(states, n, seed):
    from itertools import product

    rng = np.random.default_rng(seed)
    start, step, emit = rng.random(states), rng.random((states, states)), rng.random((n, states))
    step /= step.sum(axis=1, keepdims=True)
    ls, lt, le = np.log(start), np.log(step), np.log(emit)
    score = lambda p: ls[p[0]] + le[0, p[0]] + sum(lt[p[t - 1], p[t]] + le[t, p[t]] for t in range(1, n))
    best = max(product(range(states), repeat=n), key=score) if states**n < 20_000 else None
    got = Q.viterbi(ls, lt, le)
    if best is not None:
        assert abs(score(tuple(got)) - score(best)) < 1e-9
    post, change = Q.forward_backward(start / start.sum(), step, emit)
    assert np.allclose(post.sum(axis=1), 1) and ((change >= -1e-9) & (change <= 1 + 1e-9)).all()


def test_allocation_and_folds():
    quota = P.root_allocation({("a",): 100, ("b",): 25, ("c",): 2}, 30)
    assert sum(quota.values()) == 30 and quota[("c",)] == 2 and quota[("a",)] > quota[("b",)]
    assert P.root_allocation({("a",): 2}, 30) == {("a",): 2} and P.root_allocation({}, 5) == {}
    assert P.greedy_folds([("x", 5), ("y", 3), ("z", 3), ("w", 1)], 2) == {"x": 1, "y": 2, "z": 2, "w": 1}


def test_greedy_matches(spark):
    pairs = spark.createDataFrame([("d", 1, 1, 0.9), ("d", 1, 2, 0.8), ("d", 2, 1, 0.85), ("d", 2, 2, 0.1), ("e", 1, 1, 0.3)], "doc string, l int, r int, s double")
    assert sorted(map(tuple, J.greedy_matches(pairs, "doc", "l", "r", "s").select("doc", "l", "r").collect())) == [("d", 1, 1), ("d", 2, 2), ("e", 1, 1)]


def test_scaling_recovers_parameters():
    rng = np.random.default_rng(1)
    z = rng.normal(size=20_000)
    y = rng.random(20_000) < 1 / (1 + np.exp(-(2 * z + 0.5)))
    a, b = L.platt(1 / (1 + np.exp(-z)), y)
    assert abs(a - 2) < 0.1 and abs(b - 0.5) < 0.1
    x = rng.normal(size=(500, 3))
    w, c = L.fit_softmax(x, (x[:, 0] > 0).astype(int), 2, c=10.0)
    assert ((L.softmax_rows(x @ w + c).argmax(axis=1) == (x[:, 0] > 0)).mean()) > 0.97


def test_segment_errors_of_equal_segmentations(spark):
    rows = spark.createDataFrame(pd.DataFrame({"d": ["x"] * 8, "pos": range(8), "a": [0, 0, 0, 1, 1, 1, 2, 2]}))
    r = Q.segment_errors(rows.withColumn("b", F.col("a")), "d", "pos", "a", "b").first()
    assert r["pk"] == 0 and r["window_diff"] == 0


def test_mixture_picks_the_component_that_fits():
    stay, move = np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[0.1, 0.9], [0.9, 0.1]])
    emissions = np.array([[0.9, 0.1], [0.1, 0.9]] * 4)
    best, posterior, path = L.mixture_decode(emissions, [np.full(2, 0.5)] * 2, [stay, move], np.full(2, 0.5))
    assert best == 1 and posterior[1] > 0.99 and path.tolist() == [0, 1] * 4


def test_chain_crf_gradient_and_decoding():
    rng = np.random.default_rng(0)
    m = L.ChainCrf(3, 2)
    m.emit, m.step, m.start = rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    x, y = rng.normal(size=(6, 3)), np.array([0, 1, 1, 0, 1, 0])
    _, grads = m.loss(x, y)
    for w, g in zip((m.emit, m.step, m.start), grads):
        for i in np.ndindex(w.shape):
            old, h = w[i], 1e-6
            w[i] = old + h
            up = m.loss(x, y)[0]
            w[i] = old - h
            down = m.loss(x, y)[0]
            w[i] = old
            assert abs((up - down) / (2 * h) - g[i]) < 1e-4


def test_hidden_layer_gradient():
    rng = np.random.default_rng(1)
    head, x, y = L.MlpHead(4, 5, 3, seed=2), rng.normal(size=(7, 4)), np.array([0, 1, 2, 0, 1, 2, 1])
    weight = np.array([1.0, 2.0, 0.5])
    _, grads = head.loss(x, y, weight, 0.01)
    for w, g in zip(head.weights, grads):
        for i in np.ndindex(w.shape):
            old, h = w[i], 1e-6
            w[i] = old + h
            up = head.loss(x, y, weight, 0.01)[0]
            w[i] = old - h
            down = head.loss(x, y, weight, 0.01)[0]
            w[i] = old
            if w.ndim == 2:
                assert abs((up - down) / (2 * h) - g[i]) < 1e-4


def test_scaling_with_weights_is_scaling_of_rows():
    rng = np.random.default_rng(3)
    p = np.round(rng.random(500), 2)
    correct = rng.random(500) < p**2
    values, inverse = np.unique(np.stack([p, correct], axis=1), axis=0, return_inverse=True)
    weight = np.bincount(inverse.ravel()).astype(float)
    assert np.allclose(L.weighted_platt(values[:, 0], values[:, 1], weight), L.platt(p, correct), atol=1e-6)
    q = np.clip(p, 1e-6, 1 - 1e-6)
    assert abs(L.weighted_temperature(values[:, 0], values[:, 1], weight) - L.temperature(np.stack([np.log(q), np.log(1 - q)], axis=1), (~correct).astype(int))) < 1e-4
