"""Steps whose cost must not grow faster than their input."""

import re
import time
import tracemalloc

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatherum.functions import dates as D
from gatherum.functions import text as T
from gatherum.operators import atoms as A
from gatherum.operators import checks as K
from gatherum.operators import joins as J
from gatherum.operators import models as L
from gatherum.operators import parts as P
from gatherum.operators import writer as W
from gatherum.plans import q_documents, sparql
from gatherum.plans.catalogue import ORACLE_SQL, QUERIES
from gatherum.plans.registry import dealt, table

V = "http://v/"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_shapes_send_no_quads_to_the_driver(spark):
    rows = [("s%d" % k, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", V + "T", "iri", None) for k in range(20)] + [("s%d" % k, V + "p", "x", "literal", None) for k in range(0, 20, 2)]
    quads = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string")
    shapes = spark.createDataFrame([(V + "T", V + "p", 1, 1, None, None, None)], "target string, path string, least int, most int, kind string, datatype string, pattern string")
    found = K.shape_violations(quads, shapes)
    assert {r["s"] for r in found.collect()} == {"s%d" % k for k in range(1, 20, 2)}
    plan = executed(found)
    assert "SortMergeJoin [s" in plan and plan.split("Initial Plan")[0].count("BroadcastHashJoin") == 1


def test_dates_are_cut_by_a_mark_not_by_their_pattern(spark):
    text = "\0 1.2.2020\0 und 3. mars 1999, 30.2.2020 2021-05-06"
    df = spark.createDataFrame([(text,)], "t string").select(D.find_dates(F.col("t")).alias("h"))
    assert [(h["day"], text[h["start"] : h["stop"]]) for h in df.first()["h"]] == [("2020-02-01", "1.2.2020"), ("1999-03-03", "3. mars 1999"), ("2021-05-06", "2021-05-06")]
    assert not re.search(r"split\((?:[^()]|\([^()]*\))*, \(\?iu\)", df._jdf.queryExecution().analyzed().toString())  # it would be compiled for each text


def test_rows_of_small_files_are_dealt(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    df = dealt(table(spark, str(tmp_path), "t"), "id", 100)
    assert df.rdd.getNumPartitions() == 10 and df.count() == 1000
    assert dealt(table(spark, str(tmp_path), "t"), "id").rdd.getNumPartitions() == 1


def test_indents_of_columns_are_those_of_the_sql(spark, tmp_path):
    words = "aaa " * 6
    texts = ["Y. abcde " + words, "7100234916554344 abcde " + words, "- abcde " + words, "12 34 abcde " + words, "", "x " + "bb abcde " * 900, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sql = duckdb.sql(f"WITH documents AS (FROM '{tmp_path}/documents.parquet/*.parquet') {ORACLE_SQL['d3_atoms_of_columns']}").fetchall()
    got = QUERIES["d3_atoms_of_columns"](spark, str(tmp_path)).select("doc_id", "pieces", "lines_with_columns").collect()
    assert sorted(map(tuple, got)) == sorted(sql)


def test_indents_by_first_words_are_those_of_all(spark):
    """Gaps behind marks of all kinds: the same cuts as by the pattern on all that stands before them."""
    lines = ["art. 12 bis : word", "art 1abc def ghi", "( 1 ) word", "1 . 2 . 3 word", "xv. word", "- - word", "  3) word", "a b c d", "Teil IV word", "§ 7 word more", "(a) word", "1 2 3 4 word", "é. word"]
    rows = []
    for text in lines:
        at, x, words = 0, 0.0, []
        for w in text.split(" "):
            words.append((w, at, x, x + 1.0))
            at, x = at + len(w) + 1, x + 101.0
        for cut in range(1, len(words)):  # one gap is a hundred points, the others are one
            moved, x = [], 0.0
            for k, (w, p, _, _) in enumerate(words):
                x += 100.0 if k == cut else 1.0
                moved.append((w, p, x, x))
            left = [w for w, *_ in words[:cut]]
            rows.append((moved, left, words[cut][1]))
    df = spark.createDataFrame(rows, "w array<struct<text: string, start: int, x0: double, x1: double>>, l array<string>, at int")
    hangs = F.array_join("l", " ").rlike(A._INDENT) | F.array_join("l", "").rlike(A._INDENT)
    assert df.where(F.when(hangs, F.array().cast("array<int>")).otherwise(F.array("at")) != A.column_cuts(F.col("w"))).collect() == []
    assert 0 < df.where(hangs).count() < df.count()


def test_words_of_lines_are_split_once(spark, tmp_path):
    """Within a lambda an expression of its surroundings is made anew for each element."""
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = q_documents._placed_blocks(spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"split\([^()]*,  , -1\)", plan)) == 1


def test_equal_boxes_are_compared_once(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("p_partkey"), F.lit(7).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(3000).select(F.col("id").alias("s_suppkey"), (F.col("id") % 2).cast("int").alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["j13_box_iou"](spark, str(tmp_path))
    tables = "".join(f"{t} AS (FROM '{tmp_path}/{t}.parquet/*.parquet'), " for t in ("part", "supplier"))
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(f"WITH {tables[:-2]} {ORACLE_SQL['j13_box_iou']}").fetchall()) != []
    assert executed(got).count("SortMergeJoin") >= 2


def test_gaps_are_matched_in_a_stream(spark):
    """No call of pandas for each document; nearest free gaps, of equally near ones the first, in documents with and without a name."""
    one = lambda rows: spark.createDataFrame(rows, "d string, at long")
    found = P.nearest_gaps(one([("a", 5), ("a", 10), ("a", 12), (None, 4), ("c", 1), ("c", None)]), one([("a", 5), ("a", 9), ("a", 11), (None, 3), (None, 5), ("b", 2)]), "d", "at")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("a", 5, 5, 0), ("a", 10, 9, -1), ("a", 12, 11, -1), (None, 4, 3, -1), (None, None, 5, None), ("b", None, 2, None), ("c", 1, None, None)]))
    assert "FlatMapGroups" not in executed(found)


@pytest.mark.parametrize("function", [T.fold, T.norm])
def test_texts_of_a_batch_are_not_all_held_as_words(function):
    texts = pd.Series([f"Ein Wörtchen{k} à la caf\u0065\u0301 " * 200 for k in range(400)] + [None], dtype="object")
    size = int(texts.fillna("").str.len().sum())
    tracemalloc.start()
    try:
        out = function.func(texts)
        assert tracemalloc.get_traced_memory()[1] < 2 * size
    finally:
        tracemalloc.stop()
    assert out.iloc[-1] == "" and out.iloc[0].split()[:2] == (["ein", "wortchen0"] if function is T.fold else ["Ein", "Wörtchen0"])


def test_joining_lines_does_not_search_all_text_before_each():
    began = time.perf_counter()
    joined = T.join_hyphenated(["Gemein-", "derat und Kirchen-", "gemeinde", ""] * 10_000, {"gemeinderat"})
    assert time.perf_counter() - began < 5 and joined == " ".join(["Gemeinderat und Kirchen-gemeinde"] * 10_000)


def test_read_records_are_compared_without_a_row_per_leaf(spark):
    kind, origins = "struct<id: string, a: string, many: array<struct<id: string, b: int>>>", "array<struct<path: string, value: string, source: string>>"
    told = [("a", "x", "s"), ("many[0].b", "1", "s"), ("many[1].b", "2", "s")]
    rows = spark.createDataFrame([(1, ("i", "x", [("j", 1), ("k", 2)]), told), (2, ("i", "x", [("j", 1)]), told[:1]), (3, ("i", "x", []), told)], f"key int, record {kind}, origins {origins}")
    back = spark.createDataFrame([(1, ("i", "x", [("j", 1), ("k", 2)])), (2, ("i", "x", [("j", 1)])), (3, ("i", "y", [])), (4, ("i", None, [("j", 5)]))], f"key int, record {kind}")
    found = W.compared(back, rows, "key")
    assert found.collect() == [(2, 7, 3)]
    assert "Generate" not in executed(found)


def test_matches_are_dealt_to_tasks_by_the_size_of_the_table(spark, tmp_path):
    spark.range(250_000).select((F.col("id") % 100_000).alias("l_orderkey"), F.col("id").cast("int").alias("l_linenumber"), (F.col("id") % 7).cast("double").alias("l_quantity")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = QUERIES["j14_greedy_matches"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\([^,]*, (\d+)\)", plan) and set(re.findall(r"hashpartitioning\([^,]*, (\d+)\)", plan)) == {"3"}


def test_rows_with_equal_keys_are_sorted_in_several_tasks(spark):
    rows = [("s%d" % k, V + "p", "1", "literal", "http://www.w3.org/2001/XMLSchema#integer") for k in range(9)]
    quads = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string").select(F.lit(None).cast("string").alias("g"), "*", F.lit(None).cast("string").alias("o_lang"))
    found = sparql.run(quads, f"SELECT ?s ?o {{ ?s <{V}p> ?o }} ORDER BY ?o")
    assert found.count() == 9 and re.search(r"rangepartitioning\(.*xxhash64", executed(found))


def test_words_of_blocks_are_laid_out_once(spark, tmp_path):
    """A filter on the size of an exploded array makes the array a second time."""
    spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["d3_cover_of_atoms"](spark, str(tmp_path))
    assert got.collect() == [(1, 0, 2)]
    assert "size(arrays_zip(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_cut_by_a_mark_not_by_their_pattern(spark):
    """``split`` would compile the pattern for each text and token."""
    told = [("Eins. Zwei?! Drei", ["Eins.", " Zwei?!", " Drei"]), ("a\0b. C", ["a\0b.", " C"]), ("Nr. Eins.", ["Nr. Eins."]), ("", [""]), (None, None)]
    df = spark.createDataFrame(told, "t string, e array<string>")
    assert df.where(~T.sentence_pieces(F.col("t")).eqNullSafe(F.col("e"))).collect() == []
    unspaced = [("zu Ende.Am Tag", ["zu Ende.", "Am Tag"]), ("siehe www.Ort.Am zu Ende!Am", ["siehe www.Ort.Am zu Ende!", "Am"]), ("Nr.Eins x.Am", ["Nr.Eins x.Am"]), ("", [""])]
    df = spark.createDataFrame(unspaced, "t string, e array<string>").withColumn("got", T.unspaced_pieces(F.col("t")))
    assert df.where("got <> e").collect() == []
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_vectors_of_a_cell_are_no_objects():
    """Rows become one matrix, over chunks, without a list or an array for each."""
    values = pa.array(range(64 * 5000), pa.float32())
    column = pa.chunked_array([pa.ListArray.from_arrays(pa.array(range(0, 64 * 5001, 64), pa.int32()), values)] * 2).slice(1)
    tracemalloc.start()
    try:
        x = L.vectors_of(column)
        assert tracemalloc.get_traced_memory()[1] < 2 * x.nbytes
    finally:
        tracemalloc.stop()
    assert x.shape == (9999, 64) and x[0, 0] == 64 and x[4999, 1] == 1 and x[-1, -1] == 64 * 5000 - 1
