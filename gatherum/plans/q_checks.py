"""Queries: sources and sinks that write and read back, checks of graphs and schemas, models, and rows whose results must differ from row to row."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gatherum.functions import text as T
from gatherum.operators import checks as K
from gatherum.operators import graph as G
from gatherum.operators import joins as J
from gatherum.operators import measure as M
from gatherum.operators import models as L
from gatherum.operators import profile as P
from gatherum.operators import records as C
from gatherum.operators import sequence as Q
from gatherum.plans import sparql
from gatherum.plans.q_measures import V, _PREFIX, _scored, quads
from gatherum.plans.registry import dealt, query, table
from gatherum.plans.samples import Samples
from gatherum.sources import records as S
from gatherum.sources import trig, yaml_records
from gatherum.sources.scratch import shared_path

# ---- sources and sinks

_ORDER = StructType([StructField("id", LongType()), StructField("status", StringType())])


def _written_lines(spark, d):
    """A folder of gzipped lines of JSON for each of four parts; every 97th line is cut off."""
    path = shared_path(spark, "ndjson")
    line = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    rows = table(spark, d, "orders").select(F.pmod("o_orderkey", F.lit(4)).alias("part"), F.when(F.pmod("o_orderkey", F.lit(97)) == 0, F.substring(line, 1, 8)).otherwise(line).alias("value"))
    rows.write.partitionBy("part").option("compression", "gzip").text(path)
    return path


@query("s2_errors_per_file", "SELECT o_orderkey % 4 AS part, count(*) AS lines, count(*) FILTER (o_orderkey % 97 = 0) AS errors FROM orders GROUP BY 1")
def s2(spark, d):
    found = S.parse_errors(spark, _written_lines(spark, d) + "/*", _ORDER)
    return found.groupBy(F.regexp_extract("file", r"/part=(\d+)/", 1).cast("long").alias("part")).agg(F.sum("lines").alias("lines"), F.sum("errors").alias("errors"))


@query("s3_read_lines", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 97 <> 0")
def s3(spark, d):
    return S.read_ndjson(spark, _written_lines(spark, d) + "/*", _ORDER).where("_corrupt is null").select("id", "status")


@query("s5_csv_with_repeated_names", "SELECT c_custkey::VARCHAR AS id, c_mktsegment AS name FROM customer")
def s5(spark, d):
    """Written as gzipped CSV with a column name that comes twice: the last one counts."""
    path = shared_path(spark, "csv")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("a"), F.concat("c_name", F.lit(', "x"')).alias("b"), F.col("c_mktsegment").alias("c"))
    S.write_csv(rows, path, ["id", "name", "name"])
    return S.read_csv(spark, path)


@query("s6_sorted_parts", "SELECT count(*) AS n, 0::BIGINT AS defects, min(o_orderkey) AS first, max(o_orderkey) AS last, bit_xor(o_orderkey * 3) AS mark FROM orders")
def s6(spark, d):
    """Parts that are sorted by themselves and follow one another: read file after file, the whole is in order."""
    path = shared_path(spark, "sorted")
    S.write_sorted(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, ["o_orderkey"])
    rows = spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("place", F.monotonically_increasing_id()).withColumn("k", F.split("value", "\t").getItem(0).cast("long"))
    inside = rows.withColumn("before", F.lag("k").over(Window.partitionBy("file").orderBy("place"))).groupBy("file").agg(F.count_if(F.col("k") < F.col("before")).alias("bad"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n"), F.expr("bit_xor(k * 3)").alias("mark"))
    between = inside.withColumn("bad", F.col("bad") + F.when(F.col("lo") < F.lag("hi").over(Window.orderBy("file")), 1).otherwise(0))  # a row for each file
    return between.agg(F.sum("n").alias("n"), F.sum("bad").alias("defects"), F.min("lo").alias("first"), F.max("hi").alias("last"), F.expr("bit_xor(mark)").alias("mark"))


@query("s11_yaml_records", """SELECT c_custkey, c_name AS name, 'a: ' || c_mktsegment || '||- x' AS tags, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END::BIGINT AS nation, c_custkey % 3 = 0 AS flag FROM customer""")
def s11(spark, d):
    """Nested records as YAML text and back."""
    c = table(spark, d, "customer")
    inner = F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).cast("long").alias("nation"), (F.col("c_custkey") % 3 == 0).alias("flag"))
    record = F.struct(F.col("c_name").alias("name"), F.array(F.concat(F.lit("a: "), "c_mktsegment"), F.lit(""), F.lit("- x")).alias("tags"), inner.alias("place"))
    rows = c.select("c_custkey", record.alias("r"))
    texts = rows.select("c_custkey", yaml_records.to_yaml(F.col("r"), rows.schema["r"].dataType).alias("text"))
    back = yaml_records.from_yaml(texts, "c_custkey", "text", rows.schema["r"].dataType)
    return back.select("c_custkey", "record.name", F.array_join("record.tags", "|").alias("tags"), "record.place.nation", "record.place.flag")


@query("s12_trig_round_trip", f"SELECT p, o_kind, count(*) AS n FROM (SELECT unnest(['{G.RDF_TYPE}', '{V}name', '{V}region']) AS p, unnest(['iri', 'literal', 'iri']) AS o_kind FROM nation UNION ALL SELECT unnest(['{G.RDF_TYPE}', '{V}name']), unnest(['iri', 'literal']) FROM region UNION ALL SELECT unnest(['{G.RDF_TYPE}', '{V}name', '{V}nation']), unnest(['iri', 'literal', 'iri']) FROM (SELECT 1 FROM supplier UNION ALL SELECT 1 FROM supplier) UNION ALL SELECT unnest(['{G.RDF_TYPE}', '{V}name', '{V}size']), unnest(['iri', 'literal', 'literal']) FROM part) GROUP BY ALL")
def s12(spark, d):
    """Quads as TriG and back; only quads that come back unchanged count."""
    q = quads(spark, d)
    cols = ["g", "s", "p", "o", "o_kind", "o_datatype", "o_lang"]
    back = trig.from_trig(trig.to_trig(q).withColumnRenamed("s", "subject"), "subject", "value").where("error is null").select(*cols)
    return back.intersectAll(q.select(*cols)).groupBy("p", "o_kind").agg(F.count("*").alias("n"))


_TRIG = Samples("text string", ("n", "line", "col"), [
    ("@prefix v: <http://v/> . v:a a v:B ; v:p 1, 2.5 , \"x\"@de .", 4, None, None), ("PREFIX v: <http://v/>\n<http://g> { v:a v:p true . v:a v:q \"a\\\"b\\nc\"^^v:t }", 2, None, None), ("v:a v:p 1 .", 0, 1, 1), ("<http://a> <http://p> 1", 0, 1, 24), ("<http://a> <http://p> ;", 0, 1, 23),
    ("# only a comment\n", 0, None, None), ("<http://a>\n  <http://p>\n  % .", 0, 3, 3), ("<http://g> { <http://a> <http://p> _:b . _:b a <http://c> . }", 2, None, None), ("\"x\" <http://p> 1 .", 0, 1, 5), ("<http://a> 5 1 .", 0, 1, 14), ("<http://g> { <http://a> <http://p> 1 .", 0, 1, 39),
])


@query("s13_trig_errors", _TRIG.sql("customer", "c_custkey"))
def s13(spark, d):
    rows = _TRIG.over(table(spark, d, "customer"), "c_custkey")
    read = trig.from_trig(rows, "c_custkey", "text")
    found = read.groupBy("c_custkey").agg(F.count_if(F.col("error").isNull()).alias("n"), F.min("line").alias("line"), F.min("column").alias("col"))
    return rows.select("c_custkey").join(found, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "line", "col")


@query("s14_vector_checks", "SELECT vec_id, CASE vec_id % 11 WHEN 1 THEN 'missing' WHEN 2 THEN 'shape' WHEN 3 THEN 'not_finite' WHEN 4 THEN 'repeated' END AS reason FROM embeddings WHERE vec_id % 11 IN (1, 2, 3, 4) UNION ALL SELECT vec_id + 10000000, 'unknown' FROM embeddings WHERE vec_id % 11 = 5")
def s14(spark, d):
    """Stored vectors with faults against the ids that there should be."""
    e = table(spark, d, "embeddings")
    k = F.col("vec_id") % 11
    vector = F.when(k == 2, F.slice("embedding", 1, 3)).when(k == 3, F.concat(F.slice("embedding", 2, F.size("embedding") - 1), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    stored = e.where(k != 1).select("vec_id", vector.alias("embedding"))
    stored = stored.unionByName(stored.where(k == 4)).unionByName(stored.where(k == 5).withColumn("vec_id", F.col("vec_id") + 10_000_000))
    width = len(e.select("embedding").first()[0])
    return K.vector_violations(stored, e, "vec_id", "embedding", width)


# ---- joins, sequences


@query("j3_orphans", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)")
def j3(spark, d):
    e, c = table(spark, d, "events"), table(spark, d, "customer").where("c_custkey % 5 <> 0")
    return e.join(c, e.user_id == c.c_custkey, "left_anti").select("event_id")


_ALIGNED = Samples("a string, b string", ("pairs",), [
    ("der Rat beschliesst heute", "der Rat beschliesst", "0-0 1-1 2-2"), ("a b c d", "x b y d", "1-1 3-3"), ("eins zwei drei", "zwei drei", "1-0 2-1"), ("", "a", ""), ("a a a", "a a", "0-0 1-1"), ("Seite 1 Text", "Text", "2-0"), ("k l m", "n o", ""),
])


@query("j16_word_alignment", _ALIGNED.sql("customer", "c_custkey"))
def j16(spark, d):
    rows = _ALIGNED.over(table(spark, d, "customer"), "c_custkey")
    places = J.aligned_rows(rows, "c_custkey", "a", "b").groupBy("c_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a_word", "b_word"))), lambda x: F.concat_ws("-", x["a_word"].cast("string"), x["b_word"].cast("string"))), " ").alias("pairs"))
    return rows.select("c_custkey").join(places, "c_custkey", "left").select("c_custkey", F.coalesce("pairs", F.lit("")).alias("pairs"))


_FIELDS = Samples("text string", ("key", "value"), [
    ("Datum: 3. Mai 2020", "Datum", "3. Mai 2020"), ("  Art des Vorstosses :  Motion ", "Art des Vorstosses", "Motion"), ("Nr: 12", "Nr", "12"), ("ein sehr langer Schlüssel mit sechs Wörtern: x", None, None), ("12: x", None, None), ("Datum:", None, None), ("kein Doppelpunkt", None, None), ("a: b: c", "a", "b: c"),
])


@query("j17_key_values", _FIELDS.sql("customer", "c_custkey"))
def j17(spark, d):
    return J.key_values(_FIELDS.over(table(spark, d, "customer"), "c_custkey"), "text").select("c_custkey", "key", "value")


_FORM_CELLS = Samples("form int, pos int, x double, y double, text string", ("key", "value"), [
    (0, 0, 10.0, 10.0, "Datum:", "Datum", "3. Mai"), (0, 1, 60.0, 11.0, "3. Mai", None, None), (0, 2, 10.0, 30.0, "Art", "Art", "Motion"), (0, 3, 10.0, 42.0, "Motion", None, None), (0, 4, 10.0, 90.0, "Ort: Bern", "Ort", "Bern"), (1, 0, 10.0, 10.0, "Datum:", None, None), (1, 1, 10.0, 80.0, "weit unten", None, None),
])


@query("d14_form_fields", f"SELECT s_suppkey, k, key, value FROM ({_FORM_CELLS.of_each_sql('supplier', 's_suppkey')}) WHERE key IS NOT NULL")
def d14(spark, d):
    rows = _FORM_CELLS.of_each(table(spark, d, "supplier"), "s_suppkey").withColumn("id", F.concat_ws("-", "s_suppkey", "form"))
    return J.form_fields(rows, "id", "k", "x", "y", "text", ["datum", "art", "ort"]).join(rows.select("id", "k", "s_suppkey"), ["id", "k"]).select("s_suppkey", "k", "key", "value")


_NUMBERED = Samples("doc int, line int, text string", ("follows",), [(0, 0, "1. Antrag", False), (0, 1, "Text", False), (0, 2, "2. Gründe", True), (0, 3, "4. Schluss", False), (0, 4, "5 Ende", True), (1, 0, "3. x", False), (1, 1, "3. y", False), (1, 2, "4. z", True)])


@query("w12_next_number", f"SELECT s_suppkey, k FROM ({_NUMBERED.of_each_sql('supplier', 's_suppkey')}) WHERE follows")
def w12(spark, d):
    rows = _NUMBERED.of_each(table(spark, d, "supplier"), "s_suppkey").withColumn("id", F.concat_ws("-", "s_suppkey", "doc"))
    return Q.next_numbers(rows, "id", "line", "text").select("s_suppkey", "k")


_CUT = Samples("doc int, start long, stop long", ("n_overlaps", "covered"), [(0, 0, 5, 0, 10), (0, 6, 11, 0, 10), (1, 0, 5, 1, 8), (1, 4, 7, 1, 8), (2, 0, 5, 0, 8), (2, 8, 11, 0, 8)])


@query("d4_cover_proof", f"SELECT DISTINCT s_suppkey, k // 2 AS doc, n_overlaps, covered FROM ({_CUT.of_each_sql('supplier', 's_suppkey')}) WHERE k > 1")
def d4(spark, d):
    """Texts of eleven characters with a line feed: one is covered by its lines once, one has lines that overlap, one has a hole."""
    rows = _CUT.of_each(table(spark, d, "supplier"), "s_suppkey").withColumn("id", F.concat_ws("-", "s_suppkey", "doc"))
    texts = rows.select("id", F.lit(10).cast("long").alias("expected")).distinct()
    bad = Q.cover_defects(rows, "id", "start", "stop", texts, "expected")
    return bad.join(rows.select("id", "s_suppkey", "doc").distinct(), "id").select("s_suppkey", "doc", F.col("overlaps").alias("n_overlaps"), "covered")


@query("e2_units_and_lines", "SELECT user_id AS doc_id, count(*) AS lines, count(*) FILTER (fresh) AS units, count(*) FILTER (event_type = 'view') AS views FROM (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS fresh FROM events) GROUP BY user_id")
def e2(spark, d):
    """Lines to segments and back: as many lines, with the answers they had."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (F.row_number().over(w) - 1).alias("line"), F.col("event_type").alias("answer"))
    units = C.lines_to_units(rows, "answer")
    back = C.units_to_lines(units.withColumn("unit", F.col("answer")))
    return back.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("unit") == "view").alias("views")).join(units.groupBy("doc_id").agg(F.count("*").alias("units")), "doc_id")


@query("w10_window_diff", "SELECT user_id, round(coalesce(avg(CASE WHEN b.cr - a.cr <> b.ch - a.ch THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0.0), 9) AS window_diff FROM (SELECT user_id, pos, (pos // 4)::BIGINT AS cr, ((pos + user_id % 3) // 5 - (user_id % 3) // 5)::BIGINT AS ch, greatest(1, round_even(n / (((n - 1) // 4 + 1) * 2)::DOUBLE, 0))::INTEGER AS k FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)) a LEFT JOIN (SELECT user_id AS u, pos AS q, (pos // 4)::BIGINT AS cr, ((pos + user_id % 3) // 5 - (user_id % 3) // 5)::BIGINT AS ch FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)) b ON u = user_id AND q = pos + k GROUP BY user_id".replace("avg(CASE WHEN b.cr", "avg(CASE WHEN b.cr IS NULL THEN NULL WHEN b.cr"))
def w10(spark, d):
    """Borders of the first are every fourth row, those of the second every fifth from a place of its own: running counts in closed form."""
    rows = table(spark, d, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    rows = rows.select("user_id", "pos", F.floor(F.col("pos") / 4).alias("ref"), F.floor((F.col("pos") + F.col("user_id") % 3) / 5).alias("hyp"))
    return Q.segment_errors(rows, "user_id", "pos", "ref", "hyp").select("user_id", F.round("window_diff", 9).alias("window_diff"))


_STEPS = Samples("pos int, p0 double, p1 double, p2 double", ("state",), [(0, 0.9, 0.05, 0.05, 0), (1, 0.4, 0.5, 0.1, 1), (2, 0.1, 0.8, 0.1, 1), (3, 0.1, 0.8, 0.1, 1), (4, 0.9, 0.05, 0.05, 2), (5, 0.05, 0.05, 0.9, 2), (6, 0.1, 0.1, 0.8, 2)])


@query("w15_masked_viterbi", f"SELECT s_suppkey, k, state::BIGINT AS state FROM ({_STEPS.of_each_sql('supplier', 's_suppkey')})")
def w15(spark, d):
    """Three states that only go forward; the step back that the fifth row asks for is masked."""
    rows = _STEPS.of_each(table(spark, d, "supplier"), "s_suppkey").withColumn("p", F.array("p0", "p1", "p2"))
    step = [[0.6, 0.4, 0.0], [0.0, 0.6, 0.4], [0.0, 0.0, 1.0]]
    return Q.decode(rows, "s_suppkey", "pos", "p", [1.0, 0.0, 0.0], step).select("s_suppkey", F.col("pos").alias("k"), "state")


# ---- aggregates, samples, measures


@query("a10_need_rating", "SELECT feature, rating FROM (VALUES ('everywhere', 'breit'), ('half', 'teilweise'), ('few', 'selten'), ('none', 'keine'), ('wide_but_thin', 'teilweise')) v(feature, rating)")
def a10(spark, d):
    """Twelve groups of ten rows each of the largest tables' keys: features that many, some, few and no groups have."""
    base = table(spark, d, "orders").orderBy("o_orderkey").limit(120).select(F.row_number().over(Window.orderBy("o_orderkey")).alias("i")).select((F.col("i") % 12).alias("g"), "i")  # a hundred and twenty rows
    has = {"everywhere": F.lit(True), "half": (F.col("g") < 6), "few": F.col("g") < 2, "wide_but_thin": F.col("i") <= 12}
    rows = base.select("i", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in has.items()]))).alias("feature"))
    matrix = P.coverage_matrix(rows, base, "g", "i")
    none = spark.createDataFrame([("none", 0, 0, 0, 12, 0.0)], "feature string, n_items long, groups_with_value long, groups_half long, groups_large_base long, share double")
    return P.silver_rating(matrix.select(none.columns).unionByName(none)).select("feature", "rating")


@query("a17_set_features", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'certain' WHEN bool_or(event_type = 'view') AND NOT bool_or(event_type = 'error') THEN 'presumed' ELSE 'none' END AS sponsor, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(DISTINCT event_type) AS n_kinds FROM events WHERE hash_bucket = 0 GROUP BY user_id".replace("events WHERE hash_bucket = 0", "(SELECT *, (event_id * 7 + user_id) % 5 AS hash_bucket FROM events) WHERE hash_bucket = 0"))
def a17(spark, d):
    """A fifth of the events, so that the sets differ from user to user."""
    rows = table(spark, d, "events").where((F.col("event_id") * 7 + F.col("user_id")) % 5 == 0)
    seen = P.set_state(rows, ["user_id"], "event_type")
    sponsor = F.when(F.array_contains("kinds", "purchase"), "certain").when(F.array_contains("kinds", "view") & ~F.array_contains("kinds", "error"), "presumed").otherwise("none")
    return seen.select("user_id", sponsor.alias("sponsor"), F.array_join("kinds", ",").alias("kinds"), F.size("kinds").cast("long").alias("n_kinds"))


@query("o4_time_limit", "SELECT 'in_time' AS query, 5::BIGINT AS n, true AS truncated, false AS timed_out UNION ALL SELECT 'late', 0, false, true")
def o4(spark, d):
    """A query within its time, cut at five rows, and one that is cancelled."""
    rows = sparql.run(quads(spark, d), _PREFIX + "SELECT ?s { ?s a v:Supplier }")
    slow = rows.withColumn("x", F.expr("aggregate(sequence(1, 100000000), 0L, (a, b) -> a + b % 7)")).where("x > 0")
    out = []
    for name, df, seconds in (("in_time", rows, 600.0), ("late", slow, 1.0)):
        some, cut, late = sparql.probe_in_time(df, 5, seconds)
        out.append((name, some.count(), cut, late))
    return spark.createDataFrame(out, "query string, n long, truncated boolean, timed_out boolean")


@query("l5_tier_calibration", "SELECT lang, k, n, round(least(greatest((k + 0.5::DOUBLE) / (n + 1), 0.005), 0.995), 9) AS p, n >= 20 AND (k + 0.5::DOUBLE) / (n + 1) >= 0.9 AS certain FROM (SELECT lang, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)")
def l5(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", (F.col("quality") == 1).alias("correct"))
    return M.tier_calibration(rows, ["lang"], "correct").select("lang", "k", "n", F.round("p", 9).alias("p"), "certain")


@query("l4_scaling")
def l4(spark, d):
    """Scores are compressed to the distinct values that are written; those alone reach the driver."""
    scores = L.compressed_scores(_scored(spark, d), "p", "correct")
    a, b = L.weighted_platt(*scores)
    return spark.createDataFrame([(round(a, 6), round(b, 6), round(L.weighted_temperature(*scores), 6))], "slope double, intercept double, temperature double")


@query("l8_choice_probabilities", "SELECT l_orderkey, l_partkey, round(CASE WHEN t > 0 THEN l_discount / t ELSE 1.0::DOUBLE / n END, 9) AS p FROM (SELECT *, sum(l_discount) OVER (PARTITION BY l_orderkey) AS t, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)")
def l8(spark, d):
    return L.choice_probabilities(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_discount").select("l_orderkey", "l_partkey", F.round("p", 9).alias("p"))


@query("l2_layer_grid")
def l2(spark, d):
    """Two layers (the vector, and its first half) and two penalties: the cell with the least loss on rows that it wasn't fitted on."""
    half = F.transform(F.slice("embedding", 1, F.floor(F.size("embedding") / 2).cast("int")), lambda x: x)
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("whole"), half.alias("half"), (F.col("label") % 4).alias("y"), (F.col("vec_id") % 3).alias("fold"))
    return L.chosen_cell(L.oof_logits(rows, "vec_id", ["whole", "half"], "y", "fold", [0.1, 1.0], 4)).select("layer", "c")


_MIXED = Samples("pos int, p0 double, p1 double", ("kind", "state"), [(0, 0.9, 0.1, 1, 0), (1, 0.8, 0.2, 1, 0), (2, 0.2, 0.8, 1, 1), (3, 0.1, 0.9, 1, 1), (4, 0.2, 0.8, 1, 1)])


@query("l6_joint_decode", f"SELECT s_suppkey, k, kind::BIGINT AS kind, state::BIGINT AS state FROM ({_MIXED.of_each_sql('supplier', 's_suppkey')})")
def l6(spark, d):
    """A component that never leaves the first state, and one that goes to the second: the second explains the rows."""
    rows = _MIXED.of_each(table(spark, d, "supplier"), "s_suppkey").withColumn("p", F.array("p0", "p1"))
    found = L.joint_decode(rows, "s_suppkey", "pos", "p", [[1.0, 0.0], [1.0, 0.0]], [[[1.0, 0.0], [0.0, 1.0]], [[0.5, 0.5], [0.0, 1.0]]], [0.5, 0.5])
    return found.select("s_suppkey", F.col("pos").alias("k"), "kind", "state")


@query("w16_chain_crf", "SELECT user_id, count(*) AS n, count(*) FILTER (r % 5 < 3) AS first_state FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events) GROUP BY user_id")
def w16(spark, d):
    """States run three rows and two rows by turns; the model learns that from a few sequences. Its features mark the first row of a run and the last of the second; the rows between follow from their neighbours."""
    features = lambda n: np.array([[1.0, float(t % 5 == 0), float(t % 5 == 3), float(t % 5 == 4)] for t in range(n)])
    model = L.ChainCrf(4, 2).fit([(features(n), np.array([int(t % 5 >= 3) for t in range(n)])) for n in (9, 14, 23)], penalty=0.001, rounds=300)
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).alias("r"))
    rows = rows.withColumn("x", F.array(F.lit(1.0), (F.col("r") % 5 == 0).cast("double"), (F.col("r") % 5 == 3).cast("double"), (F.col("r") % 5 == 4).cast("double")))
    return L.crf_decode(rows, "user_id", "r", "x", model).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("state") == 0).alias("first_state"))


@query("l10_hidden_layer_head")
def l10(spark, d):
    """A head with a hidden layer on a bounded sample of labelled vectors (2,000, by a hash of the id); the share of all rows that it gets right."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 4).cast("int").alias("y"))
    sample = e.orderBy(F.xxhash64("vec_id")).limit(2000).toPandas()
    x = np.array(sample["x"].tolist())
    head = L.MlpHead(x.shape[1], 16, 4).fit(x, sample["y"].to_numpy(), rounds=100)

    @F.pandas_udf("int")
    def predicted(v):
        return v.map(lambda r: int(head.logits(np.asarray(r)[None, :])[0].argmax())).astype("int32")

    return e.agg(F.count("*").alias("n"), F.round(F.avg((predicted("x") == F.col("y")).cast("double")), 2).alias("share"))


_TALK = Samples("text string", ("most", "last"), [
    ("Antrag Antrag Frage", "motion", "question"), ("Frage Antrag Frage Antrag", "motion", "motion"), ("Frage", "question", "question"), ("nichts", "none", "none"), ("", "none", "none"), ("Frage Frage Antrag", "question", "motion"),
])


@query("l11_keyword_baseline", _TALK.sql("customer", "c_custkey"))
def l11(spark, d):
    kinds = {"motion": "Antrag", "question": "Frage"}
    t = F.col("text")
    return _TALK.over(table(spark, d, "customer"), "c_custkey").select("c_custkey", L.keyword_baseline(t, kinds, "none").alias("most"), L.last_match_baseline(t, kinds, "none").alias("last"))


@query("l13_second_calculation", "SELECT source, 'n' AS cell, count(*)::DOUBLE AS left_value, count(*) FILTER (doc_id % 50 <> 7)::DOUBLE AS right_value FROM documents GROUP BY source HAVING count(*) FILTER (doc_id % 50 = 7) > 0 UNION ALL SELECT source, 'chars', sum(n_chars)::DOUBLE, sum(n_chars) FILTER (doc_id % 50 <> 7)::DOUBLE FROM documents GROUP BY source HAVING coalesce(sum(n_chars) FILTER (doc_id % 50 = 7), 0) > 0")
def l13(spark, d):
    """A second calculation that lacks some rows: the cells that differ."""
    docs = table(spark, d, "documents")
    sums = lambda df: df.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return L.cell_differences(sums(docs), sums(docs.where("doc_id % 50 <> 7")), ["source"])


# ---- graphs and schemas


@query("g2_nquads_round_trip", "SELECT k AS kind, n FROM (SELECT 'back' AS k, 6 * (SELECT count(*) FROM supplier) + 3 * (SELECT count(*) FROM part) + 3 * (SELECT count(*) FROM nation) + 2 * (SELECT count(*) FROM region) AS n UNION ALL SELECT 'bad', (SELECT count(*) FROM region))")
def g2(spark, d):
    """Quads as lines and back: those that come back unchanged, and lines that are none (one for each region)."""
    q = quads(spark, d)
    cols = ["g", "s", "p", "o", "o_kind", "o_datatype", "o_lang"]
    broken = table(spark, d, "region").select(F.concat(F.lit("<http://x> <http://y> "), "r_name").alias("value"))
    back = G.from_nquads(G.to_nquads(q).unionByName(broken))
    same = back.where("NOT bad").select(*cols).intersectAll(q.select(*cols)).agg(F.lit("back").alias("kind"), F.count("*").alias("n"))
    return same.unionByName(back.agg(F.lit("bad").alias("kind"), F.count_if("bad").alias("n")))


@query("g3_isomorphism", "SELECT * FROM (VALUES ('other_names', true), ('other_value', false), ('one_less', false), ('shared_child', false)) v(case_name, isomorphic)")
def g3(spark, d):
    """Trees of blank nodes, one for each order with a child for its price: under other names, with another value, with a row less, with children swapped for one."""
    def tree(tag, price=F.col("o_totalprice"), where="true", child=F.col("o_orderkey")):
        o = table(spark, d, "orders").where(where)
        root, leaf = F.concat(F.lit(f"_:{tag}r"), "o_orderkey"), F.concat(F.lit(f"_:{tag}c"), child.cast("string"))
        cell = lambda s, p, v, kind, t: F.struct(s.alias("s"), F.lit(V + p).alias("p"), v.alias("o"), F.lit(kind).alias("o_kind"), F.lit(t).cast("string").alias("o_datatype"))
        cells = F.array(cell(root, "has", leaf, "blank", None), cell(leaf, "price", price.cast("string"), "literal", G.XSD + "double"), cell(root, "key", F.col("o_orderkey").cast("string"), "literal", G.XSD + "integer"))
        return o.select(F.lit(None).cast("string").alias("g"), F.explode(cells).alias("x")).select("g", "x.*", F.lit(None).cast("string").alias("o_lang"))

    base = G.graph_digest(tree("a"))
    cases = {"other_names": tree("zz"), "other_value": tree("b", F.when(F.col("o_orderkey") == 1, 0.0).otherwise(F.col("o_totalprice"))), "one_less": tree("b", where="o_orderkey <> 1"), "shared_child": tree("b", child=F.when(F.col("o_orderkey") <= 7, F.lit(1)).otherwise(F.col("o_orderkey")))}
    parts = [G.same_digests(base, G.graph_digest(other)).select(F.lit(name).alias("case_name"), "isomorphic") for name, other in cases.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("g3_rings", "SELECT * FROM (VALUES ('renamed', true), ('turned_round', true), ('split', false)) v(case_name, isomorphic)")
def g3_rings(spark, d):
    """Each conversation of six turns or more as a ring of blank nodes, all of them alike: under other names, the other way round, and with each ring cut into two."""
    turns = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    last = Window.partitionBy("conv_id")
    turns = turns.withColumn("n", F.count("*").over(last)).withColumn("k", F.row_number().over(last.orderBy("turn")) - 1).where("n >= 6")

    def rings(tag, half=False, back=False):
        size = F.floor(F.col("n") / 2)
        start, length = (F.when(F.col("k") < size, 0).otherwise(size), F.when(F.col("k") < size, size).otherwise(F.col("n") - size)) if half else (F.lit(0), F.col("n"))
        node = lambda k: F.concat_ws("", F.lit(f"_:{tag}"), "conv_id", F.lit("x"), k.cast("long"))
        here, after = node(F.col("k")), node(start + F.pmod(F.col("k") - start + 1, length))
        none = F.lit(None).cast("string")
        return turns.select(none.alias("g"), (after if back else here).alias("s"), F.lit(V + "next").alias("p"), (here if back else after).alias("o"), F.lit("blank").alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang"))

    base = G.graph_digest(rings("a"))
    cases = {"renamed": rings("zz"), "turned_round": rings("b", back=True), "split": rings("c", half=True)}
    return reduce(DataFrame.unionByName, [G.same_digests(base, G.graph_digest(other)).select(F.lit(name).alias("case_name"), "isomorphic") for name, other in cases.items()])


@query("g10_compared_variables", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_quantity <= l_linenumber GROUP BY 1")
def g10_compared(spark, d):
    """Two variables, one a double, the other a whole number: by value, not by letter."""
    lines = G.stored(table(spark, d, "lineitem").select("l_quantity", "l_linenumber", "l_returnflag", F.monotonically_increasing_id().cast("string").alias("row")))
    q = G.to_quads(lines, V + "g/lines", F.concat_ws("/", F.lit(V + "line"), "row"), V + "Line", {V + "quantity": "l_quantity", V + "number": "l_linenumber", V + "flag": "l_returnflag"})
    text = _PREFIX + "SELECT ?flag (COUNT(?l) AS ?n) WHERE { ?l v:quantity ?q ; v:number ?k ; v:flag ?flag FILTER(?q <= ?k) } GROUP BY ?flag"
    return sparql.flat(sparql.run(G.stored(q), text))


_NEXT_SQL = "e AS (SELECT conv_id, turn AS s, turn + 1 AS d FROM (SELECT DISTINCT conv_id, turn FROM conversations) SEMI JOIN (SELECT conv_id AS c, turn AS t FROM conversations) ON c = conv_id AND t = turn + 1 UNION SELECT conv_id, max(turn), 0 FROM conversations WHERE conv_id % 5 = 0 GROUP BY conv_id)"


@query("g10_path_closure", f"WITH RECURSIVE {_NEXT_SQL}, r AS (SELECT * FROM e UNION SELECT r.conv_id, r.s, e.d FROM r JOIN e ON e.conv_id = r.conv_id AND e.s = r.d) SELECT '{V}turn/' || conv_id || '/' || s AS x, count(*) AS n FROM r GROUP BY 1")
def g10_closure(spark, d):
    """Turns that come after a turn, however late; every fifth conversation starts again at its end, so all its turns do."""
    text = _PREFIX + "SELECT ?x (COUNT(?y) AS ?n) WHERE { ?x v:next+ ?y } GROUP BY ?x"
    return sparql.flat(sparql.run(_following(spark, d), text))


@query("g10_paths_from_a_node", f"WITH RECURSIVE {_NEXT_SQL}, r AS (SELECT conv_id, turn AS s, turn AS d FROM conversations WHERE conv_id = 7 UNION SELECT r.conv_id, r.s, e.d FROM r JOIN e ON e.conv_id = r.conv_id AND e.s = r.d) SELECT '{V}turn/' || conv_id || '/' || d AS y FROM r WHERE s = 1")
def g10_from(spark, d):
    """What one turn leads to, itself included: the search starts there and doesn't look at the rest."""
    return sparql.flat(sparql.run(_following(spark, d), _PREFIX + f"SELECT ?y WHERE {{ <{V}turn/7/1> (v:next|v:nothing)* ?y }}"))


def _following(spark, d):
    """Quads: the next turn of each turn of a conversation."""
    turns = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    pairs = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"], "left_semi").select("conv_id", "turn", (F.col("turn") + 1).alias("after"))
    pairs = pairs.unionByName(turns.where("conv_id % 5 = 0").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.lit(0).cast("long").alias("after"))).distinct()
    iri = lambda c: F.concat_ws("/", F.lit(V + "turn"), "conv_id", c)
    return G.stored(G.to_quads(pairs, V + "g/talk", iri("turn"), V + "Turn", {}, {V + "next": iri("after")}))


@query("g10_ask", "SELECT * FROM (VALUES ('names', true), ('long_names', false), ('typed', true), ('other_type', false)) v(question, result)")
def g10(spark, d):
    asked = {"names": "?s v:name ?x FILTER(STRLEN(STR(?x)) > 1)", "long_names": "?s v:name ?x FILTER(STRLEN(STR(?x)) > 500)", "typed": '?s v:size "5"^^<http://www.w3.org/2001/XMLSchema#integer>', "other_type": '?s v:size "5"'}
    parts = [sparql.run(quads(spark, d), _PREFIX + f"ASK {{ {text} }}").select(F.lit(k).alias("question"), "result") for k, text in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("j19_optional", f"SELECT x, size FROM (SELECT '{V}nation/' || n_nationkey AS x, NULL AS size FROM nation UNION ALL SELECT '{V}part/' || p_partkey, p_size::VARCHAR FROM part)")
def j19(spark, d):
    return sparql.flat(sparql.run(quads(spark, d), _PREFIX + "SELECT ?x ?size WHERE { { ?x a v:Nation } UNION { ?x a v:Part } OPTIONAL { ?x v:size ?size } }"))


@query("g10_unbound_variables", f"SELECT x, y FROM (SELECT '{V}nation/' || a.n_nationkey AS x, '{V}supplier/' || s_suppkey AS y FROM nation a JOIN supplier ON s_nationkey = a.n_nationkey, range(2) UNION ALL SELECT '{V}region/' || r_regionkey, '{V}supplier/' || s_suppkey FROM region, supplier, range(2))")
def g10_unbound(spark, d):
    """Nations bind ?n, regions leave it unbound: a region goes with every supplier, a nation with its own."""
    text = _PREFIX + "SELECT ?x ?y WHERE { { ?x a v:Nation ; v:region ?r . BIND(?x AS ?n) } UNION { ?x a v:Region } ?y v:nation ?n }"
    return sparql.flat(sparql.run(quads(spark, d), text))


@query("g10_datatypes", "SELECT p_size::VARCHAR AS size, count(*) AS n FROM part WHERE p_size IN (5, 7) GROUP BY 1")
def g10_datatypes(spark, d):
    """Numbers match whole numbers; a text that looks like one doesn't."""
    text = _PREFIX + 'SELECT ?size (COUNT(?s) AS ?n) WHERE { { ?s v:size 5 } UNION { ?s v:size "7"^^<http://www.w3.org/2001/XMLSchema#integer> } UNION { ?s v:size "9" } ?s v:size ?size } GROUP BY ?size'
    return sparql.flat(sparql.run(quads(spark, d), text))


@query("g10_paths_values_having", f"SELECT r_name AS region, 2 * count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY r_name HAVING 2 * count(*) > 1 ORDER BY 1")
def g10_paths(spark, d):
    text = _PREFIX + 'SELECT ?region (COUNT(?s) AS ?n) WHERE { ?r ^v:region/^v:nation ?s ; v:name ?region . VALUES ?region { "ASIA" "EUROPE" "AFRICA" } } GROUP BY ?region HAVING(?n > 1)'
    return sparql.flat(sparql.run(quads(spark, d), text))


@query("g10_sub_select", f"SELECT n_name AS name, n FROM (SELECT n_nationkey AS k, n_name, 2 * count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) WHERE k <> 3")
def g10_sub(spark, d):
    text = _PREFIX + f"SELECT ?name ?n WHERE {{ ?x v:name ?name . {{ SELECT ?x (COUNT(?s) AS ?n) WHERE {{ ?s v:nation ?x }} GROUP BY ?x }} MINUS {{ <{V}supplier/0> v:nothing ?q . ?x v:name ?name }} FILTER(STR(?x) != \"{V}nation/3\") }}"
    return sparql.flat(sparql.run(quads(spark, d), text)).withColumn("n", F.col("n").cast("long"))


@query("g5_label_checks", "SELECT l AS label, reason FROM (SELECT doc_id AS l, unnest(list_filter([CASE WHEN doc_id % 9 = 1 THEN 'no_source' END, CASE WHEN doc_id % 9 = 2 THEN 'unknown_source' END, CASE WHEN doc_id % 9 = 3 THEN 'probability' END, CASE WHEN doc_id % 9 = 4 THEN 'calibration' END, CASE WHEN doc_id % 9 = 5 THEN 'status' END, CASE WHEN doc_id % 9 = 6 THEN 'page' END, CASE WHEN doc_id % 9 = 7 THEN 'span' END, CASE WHEN doc_id % 9 = 8 THEN 'fixed_with_probability' END], lambda x: x IS NOT NULL)) AS reason FROM labels)")
def g5(spark, d):
    k = F.col("doc_id") % 9
    source = F.when(k == 1, None).when(k == 2, "guess").when(k == 8, "copy").otherwise("rule")
    rows = table(spark, d, "labels").select(
        F.col("doc_id").alias("label"), source.alias("source"), F.when(k == 3, 0.999).when((k == 1) | (k == 2), None).otherwise(0.5).alias("probability"), F.when(k == 4, "nowhere").otherwise("plan1").alias("calibration"), F.when(k != 5, "sure").alias("status"),
        F.when(k == 6, 0).otherwise(1).alias("page"), F.lit(3).alias("start"), F.when(k == 7, 2).otherwise(9).alias("stop"),
    )
    return K.label_violations(rows, spark.createDataFrame([("plan1",)], "plan string"), ["rule", "model"], ["copy", "fixed"])


@query("g5_block_labels", "SELECT doc_id AS block, CASE doc_id % 5 WHEN 1 THEN 'not_one_label' WHEN 2 THEN 'not_one_label' WHEN 3 THEN 'other_place' END AS reason FROM labels WHERE doc_id % 5 IN (1, 2, 3) UNION ALL SELECT doc_id + 10000000, 'unknown_block' FROM labels WHERE doc_id % 5 = 4")
def g5_blocks(spark, d):
    blocks = table(spark, d, "labels").select(F.col("doc_id").alias("block"), F.lit(1).alias("page"), F.lit(0).alias("start"), F.lit(9).alias("stop"))
    k = F.col("block") % 5
    labels = blocks.where(k != 1).withColumn("page", F.when(k == 3, 2).otherwise(1))
    labels = labels.unionByName(labels.where(k == 2)).unionByName(labels.where(k == 4).withColumn("block", F.col("block") + 10_000_000))
    return K.block_label_violations(blocks, labels)


@query("g7_schema_relaxation", "SELECT * FROM (VALUES ('relaxed', 'Affair', 'missing_slot', 'no_such_slot'), ('changed', 'Affair', 'missing_slot', 'no_such_slot'), ('changed', 'Affair', 'number', 'changed'), ('changed', 'Affair', 'state', 'not_relaxed'), ('changed', 'Affair', 'title', 'removed'), ('changed', 'Body', 'extra', 'added'), ('changed', 'Body', 'state', 'changed')) v(case_name, class, slot, reason)")
def g7(spark, d):
    """Two gaps of a class are relaxed, one of which no slot has; a relaxed schema that changes more than that is found out."""
    cols = "class string, slot string, required boolean, nullable boolean"
    schema = spark.createDataFrame([("Affair", "title", True, False), ("Affair", "number", True, False), ("Affair", "state", True, False), ("Body", "name", True, False), ("Body", "state", True, False)], cols)
    gaps = spark.createDataFrame([("state",), ("missing_slot",)], "slot string")
    other = spark.createDataFrame([("Affair", "number", False, True), ("Affair", "state", True, False), ("Body", "name", True, False), ("Body", "state", False, True), ("Body", "extra", False, True)], cols)
    check = lambda name, s: K.relaxation_problems(schema, s, gaps, "Affair").select(F.lit(name).alias("case_name"), "class", "slot", "reason")
    return check("relaxed", K.relaxed_schema(schema, gaps, "Affair")).unionByName(check("changed", other))


@query("g7_relaxed_records", "SELECT schema_name, slot, count(*) AS missing FROM (SELECT unnest(['strict', 'strict', 'relaxed']) AS schema_name, unnest(['status', 'priority', 'priority']) AS slot, unnest([o_orderkey % 11 = 0, o_orderkey % 13 = 0, o_orderkey % 13 = 0]) AS gone FROM orders) WHERE gone GROUP BY ALL")
def g7_records(spark, d):
    """Orders without some status or priority: what the schema misses, and what it misses once the recorded gap, the status, is relaxed."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("priority"))
    schema = spark.createDataFrame([("Order", "status", True, False), ("Order", "priority", True, False)], "class string, slot string, required boolean, nullable boolean")
    relaxed = K.relaxed_schema(schema, spark.createDataFrame([("status",)], "slot string"), "Order")
    missing = G.missing_slots(o, "o_orderkey", ["status", "priority"])
    under = lambda name, s: missing.join(F.broadcast(s.where("required").select("slot")), "slot").groupBy("slot").agg(F.count("*").alias("missing")).select(F.lit(name).alias("schema_name"), "slot", "missing")  # a row for each slot
    return under("strict", schema).unionByName(under("relaxed", relaxed))


_RULE_SQL = "CASE WHEN p = '1-URGENT' THEN 'now' WHEN e IN ('error', 'purchase') THEN 'soon' ELSE 'later' END"


@query("e20_rules_over_values", f"SELECT 'spelt_otherwise' AS case_name, count(*) AS combinations, 0::BIGINT AS differences FROM (SELECT DISTINCT event_type AS e FROM events), (SELECT DISTINCT o_orderpriority AS p FROM orders) UNION ALL SELECT 'other_order', count(*), count(*) FILTER ({_RULE_SQL} <> CASE WHEN e IN ('error', 'purchase') THEN 'soon' WHEN p = '1-URGENT' THEN 'now' ELSE 'later' END) FROM (SELECT DISTINCT event_type AS e FROM events), (SELECT DISTINCT o_orderpriority AS p FROM orders)")
def e20_values(spark, d):
    """Rules over all combinations of the values that two tables hold: spelt otherwise, and in another order."""
    e, p = table(spark, d, "events").select(F.col("event_type").alias("e")).distinct(), table(spark, d, "orders").select(F.col("o_orderpriority").alias("p")).distinct()
    soon, urgent = F.col("e").isin("error", "purchase"), F.col("p") == "1-URGENT"
    rule = F.when(urgent, "now").when(soon, "soon").otherwise("later")
    cases = {"spelt_otherwise": F.when(~urgent, F.when(soon, "soon").otherwise("later")).otherwise("now"), "other_order": F.when(soon, "soon").when(urgent, "now").otherwise("later")}
    return reduce(DataFrame.unionByName, [K.equal_over_all([e, p], rule, other).select(F.lit(name).alias("case_name"), "combinations", "differences") for name, other in cases.items()])


@query("g9_shapes", f"SELECT s, path, reason FROM (SELECT '{V}part/' || p_partkey AS s, '{V}size' AS path, 'pattern' AS reason FROM part WHERE p_size >= 10 UNION ALL SELECT '{V}part/' || p_partkey, '{V}weight', 'too_few' FROM part UNION ALL SELECT '{V}nation/' || n_nationkey, '{V}region', 'node_kind' FROM nation UNION ALL SELECT '{V}nation/' || n_nationkey, '{V}region', 'datatype' FROM nation UNION ALL SELECT '{V}region/' || r_regionkey, '{V}name', 'too_many' FROM region)")
def g9(spark, d):
    """Shapes of which some hold and some don't: sizes of one digit, a weight, regions as texts, no names."""
    x = G.XSD
    shapes = [(V + "Part", V + "size", 1, 1, "literal", x + "integer", "^[0-9]$"), (V + "Part", V + "name", 1, 1, "literal", x + "string", None), (V + "Part", V + "weight", 1, None, None, None, None), (V + "Nation", V + "region", 1, 1, "literal", x + "string", None), (V + "Region", V + "name", None, 0, None, None, None), (V + "Supplier", V + "nation", 1, 1, "iri", None, "nation/[0-9]+$")]
    return K.shape_violations(quads(spark, d), spark.createDataFrame(shapes, "target string, path string, least int, most int, kind string, datatype string, pattern string"))


@query("e20_equal_over_combinations", "SELECT * FROM (VALUES ('same', 50::BIGINT, 0::BIGINT), ('other_order', 50, 8), ('null_blind', 50, 5)) v(case_name, combinations, differences)")
def e20(spark, d):
    """Two rules over all combinations of a number from 0 to 9 and a word (one of four, or none): spelt otherwise, in another order, and without regard to nulls."""
    n = spark.range(10).withColumnRenamed("id", "n")
    w = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "w string")
    rule = F.when(F.col("w") == "a", "x").when(F.col("n") < 2, "y").otherwise("z")
    cases = {
        "same": F.when(F.coalesce(F.col("w"), F.lit("")) == "a", "x").otherwise(F.when(F.col("n") >= 2, "z").otherwise("y")),
        "other_order": F.when(F.col("n") < 8, F.when(F.col("w") == "a", "x").when(F.col("n") < 2, "y").otherwise("z")).when(F.col("w") == "a", "y").otherwise(F.when(F.col("w").isin("b", "c", "d"), "q").otherwise("z")),
        "null_blind": F.when(F.col("w") == "a", "x").when(F.col("n") < 2, "y").when(F.col("w").isNull() & (F.col("n") < 7), "y").otherwise("z"),
    }
    parts = [K.equal_over_all([n, w], rule, other).select(F.lit(name).alias("case_name"), "combinations", "differences") for name, other in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("e26_schema_pin", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'changed' WHEN 2 THEN 'not_pinned' ELSE 'missing' END AS state FROM nation")
def e26(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey") % 4
    pins = n.where(k != 2).select("n_nationkey", F.sha2(F.when(k == 1, F.upper(F.concat("n_name", F.lit("x")))).otherwise(F.col("n_name")).cast("binary"), 256).alias("sha256"))
    return K.pinned(n.where(k != 3), pins, "n_nationkey", "n_name")


_PAIRS = Samples("a string, b string", ("missing",), [("a b b c", "b c", 2), ("a b", "b a", 0), ("", "x", 0), ("x x x", "x", 2), ("Über alles", "uber", 1), ("eins", "", 1)])


@query("f22_word_completeness", _PAIRS.sql("customer", "c_custkey"))
def f22(spark, d):
    return _PAIRS.over(table(spark, d, "customer"), "c_custkey").select("c_custkey", T.word_multiset_missing(F.col("a"), F.col("b")).cast("long").alias("missing"))


# ---- modules of section e


@query("e7_training_bundle", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || doc_id), doc_id) AS place FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND n_chars <= 20000 AND source <> 'src3' QUALIFY place <= 40")
def e7(spark, d):
    """Documents with a good label and none that bars them, of sources that aren't held out, short enough; forty of each language by a hash."""
    lab, docs = table(spark, d, "labels"), table(spark, d, "documents")
    chosen = docs.where("n_chars <= 20000 and source <> 'src3'").join(lab.where("quality = 1").select("doc_id"), "doc_id", "left_semi").join(lab.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(P.hash_order("3", "doc_id"), "doc_id"))
    return chosen.select("doc_id", "lang", place.cast("long").alias("place")).where("place <= 40")


@query("e16_block_roles", "SELECT conv_id, string_agg(role || ':' || first || '-' || last, ' ' ORDER BY first) AS record FROM (SELECT conv_id, run, role, min(turn) AS first, max(turn) AS last FROM (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS fresh FROM conversations)) GROUP BY ALL) GROUP BY conv_id")
def e16(spark, d):
    """A record of the roles of a document's blocks: runs with their first and last block."""
    runs = Q.runs(table(spark, d, "conversations"), "conv_id", "turn", "role")
    entry = F.struct("first", F.concat(F.col("role"), F.lit(":"), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string")).alias("t"))
    return runs.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["t"]), " ").alias("record"))


@query("e22_record_without_register", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'document_only' ELSE 'register' END AS kind, concat_ws(',', CASE WHEN l.doc_id IS NULL THEN 'affair_id,state' END, CASE WHEN d.doc_id % 4 = 0 THEN 'title' END) AS gaps, (CASE WHEN d.doc_id % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS problems FROM documents d LEFT JOIN labels l USING (doc_id)")
def e22(spark, d):
    """Records of documents with and without an entry in the register: without one its slots are recorded gaps, and only other missing slots are problems."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", F.col("quality").cast("string").alias("affair_id"), F.col("toxic").cast("string").alias("state"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("title"))
    return C.record_gaps(rows, "doc_id", ["affair_id", "state"], ["title"]).withColumn("gaps", F.array_join("gaps", ","))


_READ_OUT = Samples("answer string", ("choice", "state"), [
    ("B", "B", "exact"), (" b) because", "B", "loose"), ("{\"choice\": \"C\"}", "C", "json"), ("The answer is (A).", "A", "loose"), ("A or B", None, "ambiguous"), ("", None, "empty"), (None, None, "empty"), ("none of these", None, "unreadable"), ("```json\n{\"choice\": \"A\"}\n```", "A", "json"),
])


@query("e23_read_out", _READ_OUT.sql("customer", "c_custkey"))
def e23(spark, d):
    read = C.read_choice(F.col("answer"), ["A", "B", "C"])
    return _READ_OUT.over(table(spark, d, "customer"), "c_custkey").withColumn("r", read).select("c_custkey", "r.choice", "r.state")


@query("e29_published_numbers", "SELECT key, value FROM (SELECT unnest(['documents', 'sources', 'labels', 'share_good']) AS key, unnest([(SELECT count(*) FROM documents)::VARCHAR, (SELECT count(DISTINCT source) FROM documents)::VARCHAR, (SELECT count(*) FROM labels)::VARCHAR, (SELECT printf('%.4f', avg(quality)) FROM labels)]) AS value)")
def e29(spark, d):
    """The numbers that a page shows, as text."""
    docs, lab = table(spark, d, "documents"), table(spark, d, "labels")
    one = docs.agg(F.count("*").cast("string").alias("documents"), F.count_distinct("source").cast("string").alias("sources"))
    two = lab.agg(F.count("*").cast("string").alias("labels"), F.format_string("%.4f", F.avg("quality")).alias("share_good"))
    return one.join(F.broadcast(two)).select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in ("documents", "sources", "labels", "share_good")])).alias("x")).select("x.*")  # one row each
