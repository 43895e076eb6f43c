"""The pipeline's stages row by row: what each keeps, and what the last two make of the texts."""

import hashlib
import importlib.util
import pathlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gatherum.llm import bpe, decontaminate, pii

_spec = importlib.util.spec_from_file_location("plain_privacy", pathlib.Path(__file__).with_name("test_privacy.py"))
plain = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(plain)

WORDS = "the and of to in that with from this have which there would people other about because through little".split()


def rows():
    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing"]) for _ in range(n))
    item = " ".join(f"benchmark{k}" for k in range(20))
    out = [(k, text(rng.randrange(20, 90)) + f" mail u{k}@example.org, born 2001-02-{k % 27 + 1:02}", "en") for k in range(60)]
    out += [(100, out[3][1], "en"), (101, text(30) + " " + item, "en"), (None, "a row without an id, " + text(30) + " card 4111 1111 1111 1111", "en"), (103, None, "en"), (104, "", None), (105, "…!", "en"), (3, text(40), "en")]
    return [(*r, "s", None if r[1] is None else len(r[1]), k) for k, r in enumerate(out)], item


def test_stages_row_by_row(spark, tmp_path):
    import corpus_pipeline as cp

    table, item = rows()
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.conf.set(pii.KEY_SETTING, plain.KEY)
    try:
        stage, seen = docs, []
        for name, f in cp.STAGES:
            out = f(spark, stage, str(tmp_path))
            out.write.parquet(str(tmp_path / name))
            stage = spark.read.parquet(str(tmp_path / name))
            seen.append(stage.collect())
            if name != cp.STAGES[-1][0]:
                assert stage.columns == docs.columns
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    lettered = {r[-1] for r in table if r[1] and any(c.isalpha() for c in r[1])}
    assert {r["a.b"] for r in seen[0]} == lettered
    copy = next(r[-1] for r in table if r[0] == 100)
    assert {r["a.b"] for r in seen[1]} == lettered - {copy}  # one of the two equal texts stays, both rows of the repeated id 3 are unlike
    leak = next(r[-1] for r in table if r[0] == 101)
    assert {r["a.b"] for r in seen[2]} == lettered - {copy, leak} and all(decontaminate.words(r["text"]) for r in seen[2])
    before = {r["a.b"]: r["text"] for r in seen[2]}
    for r in seen[3]:
        assert r["text"] == plain.rewritten(before[r["a.b"]])[0] != before[r["a.b"]] or "@" not in before[r["a.b"]]
        assert r["n_chars"] == len(r["text"])
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((str(r["doc_id"]), library.encode_ordinary(r["text"]), hashlib.sha256(r["text"].encode()).hexdigest()) for r in seen[3])
    got = sorted((str(r["doc_id"]), r["token_ids"], r["decoded_sha256"]) for r in seen[4])
    assert got == want and "None" in {g[0] for g in got}
    assert all(r["ids_sha256"] == hashlib.sha256(np.array(r["token_ids"], dtype="<u4").tobytes()).hexdigest() for r in seen[4])


def test_runs_leave_nothing_but_the_last_table(spark, tmp_path):
    import corpus_pipeline as cp
    from gatherum.llm import common

    table, item = rows()
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    root = pathlib.Path(common.scratch_root(spark).removeprefix("file://"))
    before = set(root.iterdir()) if root.exists() else set()
    result = cp.run(spark, str(tmp_path))
    left = set(root.iterdir()) - before
    assert len(left) == 1 and next(iter(left)).name.startswith("pipeline-pii") and result.count() == pytest.approx(64, abs=3)


def test_simhash_links_documents_of_the_second_stage(spark):
    """Fingerprints within three bits link texts whose five-word shingles are too unlike."""
    import corpus_pipeline as cp
    from gatherum.llm import resemblance, simhash

    phrase = "one two three four five six seven eight nine ten eleven"
    rows = [(5, phrase), (2, " ".join(["w" + str(k) for k in range(80)])), (9, " ".join([phrase] * 3000) + " and a tail of words"), (7, " ".join([phrase] * 3001))]
    bits = lambda a, b: bin(simhash.fingerprint(a) ^ simhash.fingerprint(b)).count("1")
    assert bits(rows[2][1], rows[3][1]) <= 3 < min(bits(rows[1][1], t) for k, t in rows if k != 2)
    a, b = resemblance.shingles(rows[2][1]), resemblance.shingles(rows[3][1])
    assert len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b))
    got = cp.near_duplicate_stage(spark, spark.createDataFrame(rows[1:], "doc_id long, text string"), "").collect()
    assert {r["doc_id"] for r in got} == {2, 7}
