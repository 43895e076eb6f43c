"""Language profiles against a plain version that binds, bundles and compares one trigram at a time."""

import random
import zlib

import numpy as np
import pytest

from gatherum.llm import langid

SAY = {
    "en": "the and of to in that with from this have which there would people other about because through little".split(),
    "de": "der und die das nicht mit von für über schön ist wird werden keine zwischen schon immer gegen durch".split(),
    "el": "και το να του η της με που για από είναι δεν στο θα ένα αυτό όλα μόνο πολύ εδώ".split(),
}


def plain_vector(text):
    signs = 1 - 2 * langid.letter_bits().astype(int)
    classes = [0]
    for ch in text or "":
        c = langid.symbol_of(ch)
        if c or classes[-1]:
            classes.append(c)
    classes += [0] * (classes[-1] != 0)
    out = np.zeros(langid.DIMENSIONS, dtype=int)
    for a, b, c in zip(classes, classes[1:], classes[2:]):
        if b:
            out += np.roll(signs[a], 2) * np.roll(signs[b], 1) * signs[c]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [(k, " ".join(rng.choice(SAY[lang]) for _ in range(rng.randrange(3, 60))), lang) for k in range(150) for lang in [rng.choice(sorted(SAY))]]
    return out + [(500, "\U0001e900\U0001e923\U0001e924\U0001e922\U0001e925", "ff"), (501, "\U00010414\U00010428\U00010445", None), (502, "12 – 34", "en"), (503, None, "en"), (504, "", None), (None, "the and of", "en"), (7, "a repeated id", "en"), (7, "a repeated id", "en")]


def test_predictions_are_those_of_the_plain_version(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    sums = {}
    for k, text, lang in rows:
        if k is not None and zlib.crc32(str(k).encode()) % 4 != 2 and text is not None and lang is not None:
            sums[lang] = sums.get(lang, 0) + plain_vector(text)
    known = {lang: v / np.linalg.norm(v) for lang, v in sums.items() if v.any()}
    got = {}
    for r in langid.identify(spark, df).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert len(got[7]) == 3
    for k, text, _ in rows:
        v = plain_vector(text)
        cosines = {lang: float(p @ v / np.linalg.norm(v)) for lang, p in known.items()} if v.any() else {}
        for name, score in got[k]:
            if k == 7:
                continue
            if not cosines:
                assert (name, score) == ("und", 0.0)
            else:
                best = max(cosines.values())
                assert cosines[name] == pytest.approx(best, abs=1e-5) and score == pytest.approx(min(1, max(0, best)), abs=1e-5)
    assert got[500][0][0] != "und" and got[501][0][0] != "und" and got[502][0][0] == "und"


def test_sampling_at_any_size(spark):
    for total in (10**3, 10**9, 10**12, 10**18):
        share = (langid.hash_below(500, total) + (1 << 63)) / 2**64
        assert share == pytest.approx(500 / total, rel=1e-3)
    df = spark.range(20_000).selectExpr("id as doc_id", "'x' as text", "case when id % 1000 = 0 then 'rare' else 'common' end as lang")
    n = {r["lang"]: r["count"] for r in langid.sample(df, 2000).groupBy("lang").count().collect()}
    assert n["rare"] == 20 and 850 < n["common"] < 1150


def test_names_with_dots(spark, rows):
    df = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, `a.b` string")
    prototypes = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = langid.drop_unknown(df, prototypes)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
