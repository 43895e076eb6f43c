"""Queries: measures (a), models (l), graphs (g, j18, j19, x7), event logs (r), surfaces (u, e)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from gatherum.operators import graph as G
from gatherum.operators import measure as M
from gatherum.operators import models as L
from gatherum.operators import profile as P
from gatherum.operators import readers as R
from gatherum.operators import tiers  # noqa: F401  registers the readers
from gatherum.plans import sparql
from gatherum.plans.registry import dealt, query, table
from gatherum.streaming import jobs

_GRID = [round(0.5 + 0.05 * i, 2) for i in range(10)]
_SCORED = "(SELECT doc_id, source, lang, ((doc_id * 37) % 100 / 100.0)::DOUBLE AS p, quality = 1 AS correct FROM labels JOIN documents USING (doc_id))"


def _scored(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    return rows.select("doc_id", "source", "lang", ((F.col("doc_id") * 37) % 100 / 100.0).alias("p"), (F.col("quality") == 1).alias("correct"))


_CODE = "CASE WHEN doc_id % 11 = 0 THEN 'no_reference' WHEN doc_id % 7 = 0 THEN 'not_found' WHEN quality = 1 THEN 'equal' ELSE 'different' END"


def _outcomes(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    refs = F.when(F.col("doc_id") % 11 != 0, F.array(F.lit("1")))
    value = F.when(F.col("doc_id") % 7 != 0, F.col("quality").cast("string"))
    return rows.withColumn("outcome", M.outcome(value, refs))


@query("a21_outcome_cells", f"SELECT lang, source, *, CASE WHEN n_equal + n_different > 0 THEN n_equal / (n_equal + n_different)::DOUBLE END AS precision, CASE WHEN n_equal + n_different + n_not_found > 0 THEN n_equal / (n_equal + n_different + n_not_found)::DOUBLE END AS recall, CASE WHEN n_equal + n_different + n_not_found > 0 THEN (n_equal + n_different) / (n_equal + n_different + n_not_found)::DOUBLE END AS coverage FROM (SELECT lang, source, count(*) FILTER (o = 'equal') AS n_equal, count(*) FILTER (o = 'different') AS n_different, count(*) FILTER (o = 'not_found') AS n_not_found, count(*) FILTER (o = 'no_reference') AS n_no_reference, grouping(lang, source)::BIGINT AS cell FROM (SELECT *, {_CODE} AS o FROM labels JOIN documents USING (doc_id)) GROUP BY GROUPING SETS ((lang), (source), ()))".replace("SELECT lang, source, *, CASE", "SELECT *, CASE"))
def a21(spark, d):
    return M.cells(_outcomes(spark, d), ["lang", "source"])


@query("a22_outcome_codes", f"SELECT doc_id, {_CODE} AS outcome FROM labels")
def a22(spark, d):
    return _outcomes(spark, d).select("doc_id", "outcome")


@query("a23_jeffreys_means", f"SELECT source, least(greatest((sum(correct::BIGINT) + 0.5::DOUBLE) / (count(*) + 1.0::DOUBLE), 0.005), 0.995)::DOUBLE AS p FROM {_SCORED} GROUP BY source")
def a23(spark, d):
    from gatherum.functions import numbers as N

    return _scored(spark, d).groupBy("source").agg(N.clip(N.jeffreys_mean(F.sum(F.col("correct").cast("long")), F.count("*"))).alias("p"))


@query("a24_jeffreys_intervals")
def a24(spark, d):
    sums = _scored(spark, d).groupBy("source").agg(F.sum(F.col("correct").cast("long")).alias("k"), F.count("*").alias("n"))
    return sums.withColumn("i", M.jeffreys_interval("k", "n")).select("source", "k", "n", F.round("i.low", 9).alias("low"), F.round("i.high", 9).alias("high"))


_BIN = "CASE " + " ".join(f"WHEN p < {(b + 1) / 10!r}::DOUBLE THEN {b}" for b in range(9)) + " ELSE 9 END"


@query("a25_calibration_errors", f"SELECT round((SELECT sum(n * abs(a - b)) / sum(n) FROM (SELECT count(*) AS n, avg(p) AS a, avg(correct::INTEGER::DOUBLE) AS b FROM {_SCORED} GROUP BY {_BIN})), 9) AS ece, round((SELECT sum(n * abs(a - b)) / sum(n) FROM (SELECT count(*) AS n, avg(p) AS a, avg(correct::INTEGER::DOUBLE) AS b FROM (SELECT *, ntile(10) OVER (ORDER BY p, doc_id) AS t FROM {_SCORED}) GROUP BY t)), 9) AS ece_mass")
def a25(spark, d):
    rows = _scored(spark, d)
    one = M.expected_calibration_error(rows, "p", "correct").select(F.round("ece", 9).alias("ece"))
    return one.join(F.broadcast(M.ece_equal_mass(rows, "p", "correct", "doc_id").select(F.round("ece_mass", 9).alias("ece_mass"))))  # one row


@query("a25_probability_errors", f"SELECT count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 9) AS nll, count(*) FILTER (p >= 0.99 AND NOT correct) AS wrong_at_99 FROM (SELECT *, correct::INTEGER::DOUBLE AS y, least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS q FROM {_SCORED})")
def a25_errors(spark, d):
    e = M.probability_errors(_scored(spark, d), "p", "correct")
    return e.select("n", F.round("brier", 9).alias("brier"), F.round("nll", 9).alias("nll"), "wrong_at_99")


@query("a26_reliability", f"SELECT {_BIN}::INTEGER AS bin, count(*) AS n, round(avg(p), 9) AS mean_p, round(avg(correct::INTEGER::DOUBLE), 9) AS share_correct FROM {_SCORED} GROUP BY 1")
def a26(spark, d):
    return M.reliability(_scored(spark, d), "p", "correct").select("bin", "n", F.round("mean_p", 9).alias("mean_p"), F.round("share_correct", 9).alias("share_correct"))


_GRID_SQL = ", ".join(f"({a!r}::DOUBLE)" for a in _GRID)


@query("a26_coverage_curve", f"SELECT a, count(*) FILTER (p >= a) / count(*)::DOUBLE AS coverage, CASE WHEN count(*) FILTER (p >= a) > 0 THEN 1 - count(*) FILTER (p >= a AND correct) / (count(*) FILTER (p >= a))::DOUBLE END AS error FROM {_SCORED}, (VALUES {_GRID_SQL}) g(a) GROUP BY a")
def a26_curve(spark, d):
    return M.coverage_curve(_scored(spark, d), "p", "correct", _GRID)


@query("a27_threshold", f"SELECT a, n, k, total, m AS meets, m AND a = min(CASE WHEN m THEN a END) OVER () AS chosen FROM (SELECT *, n > 0 AND k * 100 >= n * 80 AND n * 2 >= total * 1 AS m FROM (SELECT a, count(*) FILTER (p >= a) AS n, count(*) FILTER (p >= a AND correct) AS k, count(*) AS total FROM {_SCORED}, (VALUES {_GRID_SQL}) g(a) GROUP BY a))".replace("m AND a = min(CASE WHEN m THEN a END) OVER () AS chosen", "coalesce(a = min(CASE WHEN m THEN a END) OVER (), false) AS chosen"))
def a27(spark, d):
    return M.threshold(_scored(spark, d), "p", "correct", _GRID, accuracy=(80, 100))


@query("a28_cluster_bootstrap")
def a28(spark, d):
    return M.cluster_bootstrap(_scored(spark, d), "source", "correct")


@query("a29_leave_fold_out", f"SELECT lang, fold, k_fold, n_fold, k, n, least(greatest((k + 0.5::DOUBLE) / (n + 1.0::DOUBLE), 0.005), 0.995)::DOUBLE AS p, least(greatest((k - k_fold + 0.5::DOUBLE) / (n - n_fold + 1.0::DOUBLE), 0.005), 0.995)::DOUBLE AS p_without FROM (SELECT *, sum(k_fold) OVER (PARTITION BY lang)::BIGINT AS k, sum(n_fold) OVER (PARTITION BY lang)::BIGINT AS n FROM (SELECT lang, (doc_id % 5)::INTEGER AS fold, sum(correct::INTEGER)::BIGINT AS k_fold, count(*) AS n_fold FROM {_SCORED} GROUP BY ALL))")
def a29(spark, d):
    return M.calibration(_scored(spark, d).withColumn("fold", (F.col("doc_id") % 5).cast("int")), ["lang"], "fold", "correct")


@query("a30_micro_average", "SELECT sum(h)::BIGINT AS tp, sum(y)::BIGINT AS n_hyp, sum(r)::BIGINT AS n_ref, sum(h) / sum(y)::DOUBLE AS precision, sum(h) / sum(r)::DOUBLE AS recall, round(2 * (sum(h) / sum(y)::DOUBLE) * (sum(h) / sum(r)::DOUBLE) / (sum(h) / sum(y)::DOUBLE + sum(h) / sum(r)::DOUBLE), 9) AS f1 FROM (SELECT least(quality, toxic) AS h, quality AS y, toxic AS r FROM labels)")
def a30(spark, d):
    rows = table(spark, d, "labels").select(F.least("quality", "toxic").alias("h"), "quality", "toxic")
    return M.prf(rows, "h", "quality", "toxic").withColumn("f1", F.round("f1", 9))


@query("a31_class_metrics", "SELECT coalesce(t.label, p.label) AS label, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) - coalesce(tp, 0) AS fp, coalesce(n_true, 0) - coalesce(tp, 0) AS fn, CASE WHEN n_pred > 0 THEN coalesce(tp, 0) / n_pred::DOUBLE END AS precision, CASE WHEN n_true > 0 THEN tp / n_true::DOUBLE END AS recall FROM (SELECT t AS label, count(*) FILTER (t = p) AS tp, count(*) AS n_true FROM (SELECT o_orderstatus AS t, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS p FROM orders) GROUP BY t) t FULL JOIN (SELECT p AS label, count(*) AS n_pred FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS p FROM orders) GROUP BY p) p ON t.label = p.label")
def a31(spark, d):
    rows = table(spark, d, "orders").withColumn("pred", F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("o_orderstatus")))
    return M.class_metrics(rows, "o_orderstatus", "pred")


@query("e6_selective_risk", f"SELECT place, round(avg((NOT correct)::INTEGER::DOUBLE) OVER (ORDER BY place), 9) AS risk FROM (SELECT correct, row_number() OVER (ORDER BY p DESC, doc_id) AS place FROM {_SCORED})")
def e6(spark, d):
    """Labelled rows only: the order of confidence over a measure set is one window."""
    w = Window
    rows = _scored(spark, d).select("correct", F.row_number().over(w.orderBy(F.desc("p"), "doc_id")).cast("long").alias("place"))
    return rows.select("place", F.round(F.avg((~F.col("correct")).cast("double")).over(w.orderBy("place")), 9).alias("risk"))


# ---- models


@query("l1_logistic_regression")
def l1(spark, d):
    folds = table(spark, d, "embeddings").select("embedding", (F.col("label") % 4).alias("y"), (F.col("vec_id") % 5).alias("fold"))
    return L.grouped_cv(folds, "embedding", "y", "fold", [0.1, 1.0], 4).select("c", "fold", "n", "correct")


@query("l3_nested_penalty")
def l3(spark, d):
    folds = table(spark, d, "embeddings").select("embedding", (F.col("label") % 4).alias("y"), (F.col("vec_id") % 3).alias("fold"))
    return L.nested_penalty(folds, "embedding", "y", "fold", [0.1, 1.0], 4)


@query("l7_merged_decision", "SELECT d.doc_id, CASE WHEN d.doc_id % 4 <> 0 AND (d.doc_id % 10 / 10.0 >= 0.9 OR l.doc_id IS NULL) THEN lang ELSE quality::VARCHAR END AS value, CASE WHEN d.doc_id % 4 <> 0 AND (d.doc_id % 10 / 10.0 >= 0.9 OR l.doc_id IS NULL) THEN 'rule' ELSE 'head' END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def l7(spark, d):
    rules = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("value"), (F.col("doc_id") % 10 / 10.0).alias("p"))
    return L.merged_decision(rules, table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("value"), F.lit(0.8).alias("p")))


@query("l12_coder_agreement", "SELECT count(*) AS n, count(*) FILTER (a.quality = b.quality) AS equal, count(*) FILTER (b.quality IS NULL) AS only_a, count(*) FILTER (a.quality IS NULL) AS only_b FROM (SELECT * FROM labels WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, 1 - toxic AS quality FROM labels WHERE doc_id % 2 = 0) b ON a.doc_id = b.doc_id")
def l12(spark, d):
    lab = table(spark, d, "labels")
    return L.agreement(lab.where("doc_id % 3 <> 0"), lab.where("doc_id % 2 = 0").select("doc_id", (1 - F.col("toxic")).alias("quality")), "doc_id", "quality")


# ---- graphs

V = "http://gatherum.example/"


def quads(spark, d):
    """Quads of regions, nations, suppliers and parts; suppliers stand in two graphs."""
    iri = lambda kind, c: F.concat(F.lit(f"{V}{kind}/"), F.col(c).cast("string"))
    n = G.to_quads(table(spark, d, "nation"), f"{V}g/geo", iri("nation", "n_nationkey"), f"{V}Nation", {f"{V}name": "n_name"}, {f"{V}region": iri("region", "n_regionkey")})
    r = G.to_quads(table(spark, d, "region"), f"{V}g/geo", iri("region", "r_regionkey"), f"{V}Region", {f"{V}name": "r_name"})
    s = dealt(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey")
    both = [G.to_quads(s, f"{V}g/{g}", iri("supplier", "s_suppkey"), f"{V}Supplier", {f"{V}name": "s_name"}, {f"{V}nation": iri("nation", "s_nationkey")}) for g in ("a", "b")]
    p = G.to_quads(dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey"), f"{V}g/parts", iri("part", "p_partkey"), f"{V}Part", {f"{V}name": "p_name", f"{V}size": "p_size"})
    return n.unionByName(r).unionByName(both[0]).unionByName(both[1]).unionByName(p)


@query("g1_quads_of_tables", f"SELECT p, o_kind, count(*) AS n FROM (SELECT unnest(['{G.RDF_TYPE}', '{V}name', '{V}region']) AS p, unnest(['iri', 'literal', 'iri']) AS o_kind FROM nation UNION ALL SELECT unnest(['{G.RDF_TYPE}', '{V}name']), unnest(['iri', 'literal']) FROM region UNION ALL SELECT unnest(['{G.RDF_TYPE}', '{V}name', '{V}nation']), unnest(['iri', 'literal', 'iri']) FROM (SELECT 1 FROM supplier UNION ALL SELECT 1 FROM supplier) UNION ALL SELECT unnest(['{G.RDF_TYPE}', '{V}name', '{V}size']), unnest(['iri', 'literal', 'literal']) FROM part) GROUP BY ALL")
def g1(spark, d):
    return quads(spark, d).groupBy("p", "o_kind").agg(F.count("*").alias("n"))


@query("g4_leaf_coverage", "SELECT count(*) AS missing FROM nation WHERE n_nationkey % 10 = 3")
def g4(spark, d):
    n = table(spark, d, "nation")
    leaves = n.select(F.concat(F.lit(f"{V}nation/"), F.col("n_nationkey").cast("string")).alias("s"), F.lit(f"{V}name").alias("p"), F.when(F.col("n_nationkey") % 10 == 3, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name")).alias("o"))
    return G.missing_leaves(leaves, quads(spark, d), "s", "p", "o").agg(F.count("*").alias("missing"))


@query("g6_span_checks", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'other_text' WHEN doc_id % 4 = 1 AND length(text) < 10000000 THEN 'bad_span' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason")
def g6(spark, d):
    docs = table(spark, d, "documents")
    k = F.col("doc_id") % 4
    claims = docs.select("doc_id", F.lit(0).alias("start"), F.when(k == 1, 10_000_000).otherwise(2).alias("stop"), F.when(k == 0, "\u0000\u0000").otherwise(F.substring("text", 1, 2)).alias("value"))
    return G.span_violations(claims, docs, "doc_id", "start", "stop", "value", "text").groupBy("reason").agg(F.count("*").alias("n"))


@query("g6_probability_checks", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p < 0.005 OR p > 0.995 THEN 'out_of_bounds' WHEN p_size % 3 = 0 AND p < 0.9 THEN 'not_certain' WHEN p < 0.5 THEN 'below_floor' END AS reason FROM (SELECT p_size, (p_size / 50.0)::DOUBLE AS p FROM part)) WHERE reason IS NOT NULL GROUP BY reason")
def g6_p(spark, d):
    rows = table(spark, d, "part").select((F.col("p_size") / 50.0).alias("p"), F.when(F.col("p_size") % 3 == 0, "certain").otherwise("unsure").alias("status"))
    return G.probability_violations(rows, "p", "status").groupBy("reason").agg(F.count("*").alias("n"))


@query("g8_missing_slots", "SELECT c_custkey, s AS slot FROM (SELECT c_custkey, unnest(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'a' END, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 14 <> 0 THEN 'b' END], lambda x: x IS NOT NULL)) AS s FROM customer)")
def g8(spark, d):
    c = table(spark, d, "customer")
    rows = c.select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("a"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("b"))
    return G.missing_slots(rows, "c_custkey", ["a", "b"], c.where("c_custkey % 14 = 0").select("c_custkey", F.lit("b").alias("slot")))


_PREFIX = f"PREFIX v: <{V}>\n"


@query("j18_basic_graph_pattern", f"SELECT '{V}supplier/' || s_suppkey AS s, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, range(4)")
def j18(spark, d):
    return sparql.flat(sparql.run(quads(spark, d), _PREFIX + "SELECT ?s ?region WHERE { ?s a v:Supplier ; v:nation ?n . ?n v:region ?r . ?r v:name ?region }"))


@query("a33_sparql_group_count", f"SELECT n_name AS name, 2 * count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def a33(spark, d):
    return sparql.flat(sparql.run(quads(spark, d), _PREFIX + "SELECT ?name (COUNT(?s) AS ?n) WHERE { ?s v:nation ?x . ?x v:name ?name } GROUP BY ?name ORDER BY ?name"))


@query("a34_graph_summary", "SELECT 3 * (SELECT count(*) FROM nation) + 2 * (SELECT count(*) FROM region) + 6 * (SELECT count(*) FROM supplier) + 3 * (SELECT count(*) FROM part) AS statements, 3 * (SELECT count(*) FROM nation) + 2 * (SELECT count(*) FROM region) + 3 * (SELECT count(*) FROM supplier) + 3 * (SELECT count(*) FROM part) AS triples, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) AS subjects, 4::BIGINT AS graphs")
def a34(spark, d):
    return G.summary(quads(spark, d))


@query("x7_union_is_a_bag", "SELECT 2 * count(*) AS rows, count(*) AS distinct_rows FROM supplier")
def x7(spark, d):
    q = quads(spark, d)
    text = _PREFIX + "SELECT {} ?s WHERE {{ ?s a v:Supplier }}"
    bag, once = (sparql.run(q, text.format(x)).agg(F.count("*").alias(n)) for x, n in (("", "rows"), ("DISTINCT", "distinct_rows")))
    return bag.join(F.broadcast(once))  # one row


@query("g12_filters", f"SELECT '{V}nation/' || n_nationkey AS s, n_name AS v FROM nation WHERE length(n_name) < 9 UNION ALL SELECT '{V}region/' || r_regionkey, r_name FROM region WHERE length(r_name) < 9")
def g12(spark, d):
    return sparql.flat(sparql.run(quads(spark, d), _PREFIX + 'SELECT ?s ?v WHERE { GRAPH ?g { ?s ?p ?v } FILTER(STRENDS(STR(?g), "/geo")) FILTER(isLiteral(?v) && STRLEN(STR(?v)) < 9) } ORDER BY ?s'))


@query("g13_typed_cells", f"SELECT 'literal' AS type, p_size::VARCHAR AS value, '{G.XSD}integer' AS datatype, NULL AS lang FROM part")
def g13(spark, d):
    return sparql.run(quads(spark, d), _PREFIX + "SELECT ?v WHERE { ?s v:size ?v }").select("v.*")


# ---- event logs


@query("r1_replay", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 5000")
def r1(spark, d):
    return jobs.replay(table(spark, d, "events"), "user_id", "event_id", 5000).select("event_id", "user_id", "event_type")


_JOB = "(SELECT *, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS state FROM events)"


def _jobs(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events").withColumn("state", F.when(t == "signup", "queued").when(t == "purchase", "done").when(t == "error", "failed").otherwise("running"))


@query("r2_job_states", f"SELECT user_id, coalesce(arg_min(state, event_id) FILTER (state IN ('done', 'failed', 'stopped')), arg_max(state, event_id)) AS state, count(*) AS events FROM {_JOB} GROUP BY user_id")
def r2(spark, d):
    return jobs.job_states(_jobs(spark, d), "user_id", ["event_id"], "state")


@query("r3_recent_jobs", "SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id ORDER BY last_ts DESC, user_id LIMIT 20")
def r3(spark, d):
    return jobs.recent_jobs(table(spark, d, "events"), "user_id", "ts")


@query("r4_stage_seconds", "SELECT event_type, count(*) AS n, round(sum(x) / 1000000.0::DOUBLE, 3) AS seconds FROM (SELECT event_type, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS x FROM events) WHERE x IS NOT NULL GROUP BY event_type")
def r4(spark, d):
    s = jobs.stage_seconds(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "event_type", "ts", "event_id")
    return s.withColumn("seconds", F.round("seconds", 3))


@query("r5_intake_limits", "SELECT refused, count(*) AS n FROM (SELECT CASE WHEN length(props) > 9 THEN 'too_long' WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 50 THEN 'flood' ELSE 'taken' END AS refused FROM events) GROUP BY refused")
def r5(spark, d):
    r = jobs.within_limits(table(spark, d, "events"), "props", "user_id", 9, 50, ["event_id"])
    return r.select(F.coalesce("refused", F.lit("taken")).alias("refused")).groupBy("refused").agg(F.count("*").alias("n"))


@query("r6_tumbling_windows", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def r6(spark, d):
    return jobs.tumbling(table(spark, d, "events"), "ts", "1 day", ["event_type"])


@query("r7_sessions", "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM events)) GROUP BY user_id, s")
def r7(spark, d):
    return jobs.sessions(table(spark, d, "events"), "ts", "6 hours", "user_id")


@query("u1_reader_registry", "SELECT unnest(['affair_number', 'affair_type', 'contact', 'first_author', 'responder', 'response_date', 'submission_date', 'title']) AS field")
def u1(spark, d):
    return spark.createDataFrame([(f,) for f in R.fields()], "field string")


@query("e15_latency", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most FROM events GROUP BY event_type")
def e15(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.max("value").alias("most"))


@query("p8_first_of_rules", "SELECT p_partkey, CASE WHEN p_retailprice > 1500 THEN 'high' WHEN p_size < 10 THEN 'small' END AS reason FROM part")
def p8(spark, d):
    return table(spark, d, "part").select("p_partkey", P.first_reason([("high", F.col("p_retailprice") > 1500), ("small", F.col("p_size") < 10)]).alias("reason"))


# ---- the fixed example queries over a graph of labels
# The texts of the five queries, over our own names of properties.


def label_graph(spark, d):
    """Label assertions: one per label row, with value, source and kind, a probability for most, a page, a status for some; blocks of the labelled documents with two atoms
    of text each; short head values in a graph of their own."""
    iri = lambda kind, c: F.concat(F.lit(f"{V}{kind}/"), F.col(c).cast("string"))
    k = F.col("doc_id")
    lab = table(spark, d, "labels").select("doc_id", "quality", F.when(k % 5 != 0, k % 100 / 100.0).alias("p"), (k % 7).alias("page"), F.when(k % 3 == 0, f"{V}unsure").when(k % 3 == 1, f"{V}certain").alias("status"))
    facts = G.to_quads(lab, f"{V}g/labels", iri("label", "doc_id"), f"{V}LabelAssertion", {f"{V}value": "quality", f"{V}probability": "p", f"{V}page": "page"}, {f"{V}valueStatus": F.col("status"), f"{V}labelSource": F.when(F.col("quality") == 1, f"{V}rule").otherwise(f"{V}model"), f"{V}labelKind": F.lit(f"{V}block"), f"{V}subject": iri("block", "doc_id")})
    half = F.floor(F.length("text") / 2).cast("int")
    cut = F.array(F.struct(F.lit(0).alias("start"), F.left("text", half).alias("text")), F.struct(half.alias("start"), F.substr("text", half + 1).alias("text")))
    atoms = table(spark, d, "documents").select("doc_id", F.posexplode(cut).alias("n", "a")).select("doc_id", F.lit(1).alias("position"), "a.*", F.concat(F.lit(f"{V}atom/"), "doc_id", F.lit("-"), "n").alias("atom"))
    blocks = G.to_quads(atoms, f"{V}g/labels", iri("block", "doc_id"), f"{V}PdfBlock", {f"{V}position": "position"}, {f"{V}atom": F.col("atom")}).distinct()
    lines = G.to_quads(atoms, f"{V}g/atoms", F.col("atom"), f"{V}Atom", {f"{V}start": "start", f"{V}atomText": "text"})
    heads = G.to_quads(table(spark, d, "nation"), f"{V}s/ech-0295", iri("nation", "n_nationkey"), f"{V}Nation", {f"{V}name": "n_name"})
    return facts.unionByName(blocks).unionByName(lines).unionByName(heads)


_L = f"(SELECT '{V}label/' || doc_id AS label, doc_id, quality::VARCHAR AS value, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 100 / 100.0::DOUBLE END AS p, (doc_id % 7)::VARCHAR AS page, CASE doc_id % 3 WHEN 0 THEN '{V}unsure' WHEN 1 THEN '{V}certain' END AS status, CASE WHEN quality = 1 THEN '{V}rule' ELSE '{V}model' END AS source FROM labels)"


@query("g11_labels", f"SELECT label, value, p AS probability, status, page FROM {_L}")
def g11_labels(spark, d):
    text = _PREFIX + "SELECT ?label ?value ?probability ?status ?page WHERE { ?label a v:LabelAssertion ; v:value ?value . OPTIONAL { ?label v:probability ?probability } OPTIONAL { ?label v:valueStatus ?status } OPTIONAL { ?label v:page ?page } } ORDER BY ?page ?label"
    return sparql.flat(sparql.run(label_graph(spark, d), text)).withColumn("probability", F.col("probability").cast("double"))


@query("g11_unsure", f"SELECT label, value, p AS probability, page FROM {_L} WHERE status = '{V}unsure' AND p IS NOT NULL")
def g11_unsure(spark, d):
    text = _PREFIX + "SELECT ?label ?value ?probability ?page WHERE { ?label a v:LabelAssertion ; v:valueStatus v:unsure ; v:value ?value ; v:probability ?probability . OPTIONAL { ?label v:page ?page } } ORDER BY ?probability"
    return sparql.flat(sparql.run(label_graph(spark, d), text)).withColumn("probability", F.col("probability").cast("double"))


@query("g11_sources", f"SELECT source, '{V}block' AS kind, count(*) AS labels FROM {_L} GROUP BY source")
def g11_sources(spark, d):
    return sparql.flat(sparql.run(label_graph(spark, d), _PREFIX + "SELECT ?source ?kind (COUNT(?label) AS ?labels) WHERE { ?label a v:LabelAssertion ; v:labelSource ?source ; v:labelKind ?kind . } GROUP BY ?source ?kind ORDER BY ?source ?kind"))


@query("g11_block_text", f"SELECT '1' AS position, value, p AS probability, md5(CASE n WHEN 0 THEN left(text, length(text) // 2) ELSE substr(text, length(text) // 2 + 1) END) AS text FROM {_L} JOIN documents USING (doc_id), range(2) r(n) WHERE text IS NOT NULL")
def g11_block_text(spark, d):
    """All of the text of each atom of each block, in order; rows carry its md5."""
    text = _PREFIX + "SELECT ?position ?value ?probability ?text WHERE { ?block a v:PdfBlock ; v:position ?position ; v:atom ?atom . ?atom v:start ?start . OPTIONAL { ?atom v:atomText ?text } ?label a v:LabelAssertion ; v:subject ?block ; v:value ?value . OPTIONAL { ?label v:probability ?probability } } ORDER BY ?position ?start"
    return sparql.flat(sparql.run(label_graph(spark, d), text)).withColumn("probability", F.col("probability").cast("double")).withColumn("text", F.md5(F.col("text").cast("binary")))


@query("g11_head_values", f"SELECT '{V}nation/' || n_nationkey AS subject, '{V}name' AS property, n_name AS value FROM nation")
def g11_head_values(spark, d):
    text = 'SELECT ?subject ?property ?value WHERE { GRAPH ?g { ?subject ?property ?value } FILTER(STRENDS(STR(?g), "/ech-0295")) FILTER(isLiteral(?value) && STRLEN(STR(?value)) < 200) } ORDER BY ?subject ?property'
    return sparql.flat(sparql.run(label_graph(spark, d), text))


@query("g10_union_and_minus", f"SELECT '{V}nation/' || n_nationkey AS x FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT '{V}region/' || r_regionkey FROM region")
def g10_union(spark, d):
    text = _PREFIX + f"SELECT ?x WHERE {{ {{ ?x a v:Nation }} UNION {{ ?x a v:Region }} MINUS {{ ?x v:region <{V}region/1> }} }}"
    return sparql.flat(sparql.run(quads(spark, d), text))
