"""Every registered core query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from gatherum.plans.catalogue import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{v:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    if name in ORACLE_SQL:
        r = duck.execute(ORACLE_SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows_of(names, r.fetchall())


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_fold_of_whole_texts(spark, tmp_path):
    spark.createDataFrame([(k, "Éa " * 300 + end) for k, end in enumerate("xy")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len({r["folded"] for r in QUERIES["f1_fold_any_script"](spark, str(tmp_path)).collect()}) == 2


def test_block_text_is_whole(spark, tmp_path):
    spark.createDataFrame([(k, "Éa " * 300 + end) for k, end in enumerate("xy")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{FOLDER}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    rows = QUERIES["g11_block_text"](spark, str(tmp_path)).collect()
    assert len(rows) == 4 and len({r["text"] for r in rows}) == 3  # two atoms of each text; the texts differ in their last character
