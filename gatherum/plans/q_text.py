"""Queries: text functions (f), dates (t), numbers and vectors (m)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatherum.functions import dates as D
from gatherum.functions import numbers as N
from gatherum.functions import text as T
from gatherum.plans.registry import dealt, query, table
from gatherum.sources import records as S


def _docs(spark, d):
    return table(spark, d, "documents")


_FOLD = "trim(regexp_replace(translate(replace(lower(replace({}, chr(173), '')), 'ß', 'ss'), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'))"
_WORDS = "list_filter(string_split(" + _FOLD + ", ' '), lambda x: x <> '')"


@query("f1_fold", f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded FROM documents")
def f1(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.fold_latin(F.col("text")).cast("binary")).alias("folded"))


@query("f1_fold_any_script", f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded FROM documents")
def f1_any(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.fold(F.col("text")).cast("binary")).alias("folded"))


@query("f2_norm_text", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS normal FROM documents")
def f2(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.norm(F.col("text")).cast("binary")).alias("normal"))


@query("f4_content_words", f"SELECT doc_id, len(list_filter({_WORDS.format('text')}, lambda x: NOT list_contains({T.STOP_WORDS!r}, x)))::BIGINT AS n_content FROM documents")
def f4(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.content_words(F.col("text"))).cast("long").alias("n_content"))


@query("f5_title_overlap", f"""SELECT p_partkey, CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / greatest(len(x), len(y))::DOUBLE ELSE 0.0 END AS overlap, len(list_intersect(x, y)) * 5 >= greatest(len(x), len(y)) * 4 OR a = b AS equal
  FROM (SELECT p_partkey, list_distinct({_WORDS.format('p_name')}) AS x, list_distinct({_WORDS.format('p_type')}) AS y, {_FOLD.format('p_name')} AS a, {_FOLD.format('p_type')} AS b FROM part)""")
def f5(spark, d):
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, d, "part").select("p_partkey", T.word_overlap(a, b).alias("overlap"), T.titles_equal(a, b).alias("equal"))


@query("f6_number_runs", f"SELECT c_custkey, array_to_string(list_transform(regexp_extract_all({_FOLD.format('c_name')}, '[a-z]+|[0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^0+$') THEN '0' ELSE ltrim(r, '0') END), '.') AS runs FROM customer")
def f6(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.array_join(T.number_runs(F.col("c_name")), ".").alias("runs"))


@query("f7_number_class", "SELECT c_custkey, CASE WHEN regexp_full_match(n, '[0-9]{5,}') THEN 'S1' WHEN regexp_full_match(n, '[0-9a-f]{8}') THEN 'S2' END AS class FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey * 1001)::VARCHAR WHEN c_custkey % 3 = 1 THEN left(md5(c_custkey::VARCHAR), 8) ELSE 'n ' || c_custkey END AS n FROM customer)")
def f7(spark, d):
    k = F.col("c_custkey")
    n = F.when(k % 3 == 0, (k * 1001).cast("string")).when(k % 3 == 1, F.left(F.md5(k.cast("string").cast("binary")), F.lit(8))).otherwise(F.concat(F.lit("n "), k.cast("string")))
    return table(spark, d, "customer").select("c_custkey", T.number_class(n).alias("class"))


@query("f8_earliest_key", f"SELECT doc_id, CASE WHEN len(k) > 0 THEN k[1].w END AS key FROM (SELECT doc_id, list_sort(list_filter([{{'at': instr(t, ' the'), 'l': -3, 'w': 'the'}}, {{'at': instr(t, ' der'), 'l': -3, 'w': 'der'}}, {{'at': instr(t, ' des'), 'l': -3, 'w': 'des'}}, {{'at': instr(t, ' that'), 'l': -4, 'w': 'that'}}], lambda x: x.at > 0)) AS k FROM (SELECT doc_id, ' ' || {_FOLD.format('text')} AS t FROM documents))")
def f8(spark, d):
    padded = F.concat(F.lit(" "), T.fold_latin(F.col("text")))
    keys = ["the", "der", "des", "that"]
    hits = T.let(padded, lambda t: F.array_sort(F.filter(F.array(*[F.struct(F.instr(t, f" {w}").alias("at"), F.lit(-len(w)).alias("l"), F.lit(w).alias("w")) for w in keys]), lambda x: x["at"] > 0)))
    return _docs(spark, d).select("doc_id", F.get(hits, F.lit(0))["w"].alias("key"))


@query("f10_text_key", r"SELECT doc_id, left(md5(trim(regexp_replace(text, '\s+', ' ', 'g'))), 16) AS text_key FROM documents")
def f10(spark, d):
    return _docs(spark, d).select("doc_id", T.text_key(F.col("text")).alias("text_key"))


@query("f11_char_statistics", r"SELECT doc_id, length(text)::BIGINT AS n_chars, length(regexp_replace(text, '\s+', '', 'g'))::BIGINT AS n_solid, length(regexp_replace(text, '[^\p{L}]+', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(text, '[^\x{E000}-\x{F8FF}\x{FFFD}]+', '', 'g'))::BIGINT AS n_junk FROM documents")
def f11(spark, d):
    return _docs(spark, d).select("doc_id", *[c.alias(k) for k, c in T.char_statistics(F.col("text")).items()])


@query("f12_head_markers", "SELECT doc_id, regexp_matches(lower(left(text, 3000)), 'licen[cs]e|copyright') AS licence_mark, regexp_matches(lower(left(text, 3000)), '@') AS mail_mark FROM documents")
def f12(spark, d):
    return _docs(spark, d).select("doc_id", T.head_has(F.col("text"), "licen[cs]e|copyright").alias("licence_mark"), T.head_has(F.col("text"), "@").alias("mail_mark"))


@query("f15_spaced_words", "SELECT n_nationkey, n_name AS word FROM nation")
def f15(spark, d):
    spaced = F.array_join(F.filter(F.split("n_name", ""), lambda c: c != ""), " ")
    long = F.length("n_name") >= 4
    return table(spark, d, "nation").select("n_nationkey", F.when(long & ~F.contains("n_name", F.lit(" ")) & F.col("n_name").rlike(r"^\p{L}+$"), T.contract_spaced(spaced)).otherwise(F.col("n_name")).alias("word"))


@query("f16_bullets", r"SELECT n_nationkey, '- ' AS mark0, n_name AS rest FROM nation")
def f16(spark, d):
    mark, rest = T.bullet(F.concat(F.lit("- "), "n_name"))
    return table(spark, d, "nation").select("n_nationkey", F.concat(mark, F.lit(" ")).alias("mark0"), rest.alias("rest"))


@query("f20_visible_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS visible FROM pages")
def f20(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.without_tags(F.col("html")).cast("binary")).alias("visible"))


@query("f23_snippets", "SELECT doc_id, CASE WHEN f > 0 THEN '…' ELSE '' END || substr(text, f + 1, 120) || CASE WHEN f + 120 < length(text) THEN '…' ELSE '' END AS snippet FROM (SELECT doc_id, text, greatest(least(s - 58, length(text) - 120), 0) AS f FROM (SELECT doc_id, text, length(text) // 2 AS s FROM documents))")
def f23(spark, d):
    s = F.floor(F.length("text") / 2)
    return _docs(spark, d).select("doc_id", T.snippet(F.col("text"), s, s + 4).alias("snippet"))


@query("f24_furniture_key", r"SELECT page_id, regexp_replace(b, '[^\p{L}]+', '', 'g') AS letters, regexp_replace(b, '[^0-9]+', '', 'g') AS digits FROM (SELECT page_id, regexp_replace(lower(url), '(?:seite|page|pagina|p\.)?\s*\d+\s*(?:/|von|de|di|of)\s*\d+', '', 'g') AS b FROM pages)")
def f24(spark, d):
    letters, digits = T.furniture_key(F.col("url"))
    return table(spark, d, "pages").select("page_id", letters.alias("letters"), digits.alias("digits"))


@query("f25_similarity")
def f25(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(T.similarity("p_name", "p_type"), 6).alias("ratio"))


@query("f26_percent_encode", "SELECT page_id, url_encode(url) AS encoded FROM pages")
def f26(spark, d):
    return table(spark, d, "pages").select("page_id", T.percent_encode("url").alias("encoded"))


@query("f28_canonical_hash", """SELECT n_nationkey, sha256('{"name":"' || n_name || '","region":"' || n_regionkey || '"}') AS hash FROM nation""")
def f28(spark, d):
    return table(spark, d, "nation").select("n_nationkey", S.canonical_json_hash(F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("name"), F.col("n_name"))).alias("hash"))


_LANGS = ", ".join(f"{{'n': len(list_filter(w, lambda x: list_contains({k!r}, x))), 'l': '{lang}'}}" for lang, k in T.LANGUAGE_WORDS.items())


@query("p19_guess_language", rf"SELECT doc_id, CASE WHEN h[1].n >= 3 AND h[1].n * 2 > h[2].n * 3 THEN h[1].l END AS guess FROM (SELECT doc_id, list_reverse_sort([{_LANGS}]) AS h FROM (SELECT doc_id, regexp_extract_all(lower(left(text, 20000)), '\p{{L}}+') AS w FROM documents))")
def p19(spark, d):
    return _docs(spark, d).select("doc_id", T.guess_language(F.col("text")).alias("guess"))


# ---- dates


@query("t1_find_dates", r"SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, 'numeric' AS form, 4 AS start FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderdate::DATE::VARCHAR, 'iso', 4 FROM orders WHERE o_orderkey % 2 = 1")
def t1(spark, d):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "'vom 'd.M.yyyy' an'")).otherwise(F.date_format("o_orderdate", "'vom 'yyyy-MM-dd' an'"))
    return dealt(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select("o_orderkey", F.explode(D.find_dates(text)).alias("h")).select("o_orderkey", "h.day", "h.form", "h.start")


@query("t2_register_day", "SELECT o_orderkey, CASE WHEN v = '' THEN 'empty' WHEN v LIKE '1900%' THEN 'day_1900' WHEN try_cast(left(v, 10) AS DATE) IS NULL OR NOT regexp_full_match(left(v, 10), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'bad_form' END AS reason, CASE WHEN v NOT LIKE '1900%' AND regexp_full_match(left(v, 10), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(left(v, 10) AS DATE)::VARCHAR END AS day FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '1900-01-01' WHEN 2 THEN '2020-02-30' WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS v FROM orders)")
def t2(spark, d):
    k = F.col("o_orderkey") % 5
    v = F.when(k == 0, "").when(k == 1, "1900-01-01").when(k == 2, "2020-02-30").when(k == 3, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00"))).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    rows = table(spark, d, "orders").select("o_orderkey", v.alias("v"))
    return rows.select("o_orderkey", D.register_day_reason(F.col("v")).alias("reason"), D.register_day(F.col("v")).cast("string").alias("day"))


@query("t3_compare_days", "SELECT o_orderkey, bool_or(x = 0) AS equal, bool_or(x <= 7) AS within_7_days, min(x)::INTEGER AS days FROM (SELECT o_orderkey, abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY o_orderkey")
def t3(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.to_date("l_shipdate")).alias("days"))
    return o.join(li, o.o_orderkey == li.l_orderkey).select("o_orderkey", D.compare_days(F.to_date("o_orderdate"), F.col("days")).alias("c")).select("o_orderkey", "c.equal", "c.within_7_days", "c.days")


@query("t5_date_agreement", "SELECT o_orderpriority, count(*) AS n, median(abs(x))::DOUBLE AS median_days, count(*) FILTER (abs(x) > 30) AS over_30 FROM (SELECT o_orderpriority, date_diff('day', o_orderdate::DATE, first) AS x FROM orders JOIN (SELECT l_orderkey, min(l_shipdate)::DATE AS first FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey) GROUP BY o_orderpriority")
def t5(spark, d):
    first = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("first"))
    x = F.abs(F.date_diff("first", F.to_date("o_orderdate")))
    return table(spark, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.median(x).alias("median_days"), F.count_if(x > 30).alias("over_30"))


@query("t6_day_sets", "SELECT user_id, event_type, len(list_distinct(list(ts::DATE)))::BIGINT AS n_days FROM events GROUP BY ALL")
def t6(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.size(F.collect_set(F.to_date("ts"))).cast("long").alias("n_days"))


# ---- numbers and vectors

_E = "list_transform(embedding, lambda x: x::DOUBLE)"


@query("m1_softmax", f"SELECT vec_id, round(list_max(s), 6) AS top, round(m + ln(t), 6) AS lse FROM (SELECT vec_id, m, list_sum(e) AS t, list_transform(e, lambda y: y / list_sum(e)) AS s FROM (SELECT vec_id, list_max(v) AS m, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM (SELECT vec_id, {_E} AS v FROM embeddings)))")
def m1(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.array_max(N.softmax(F.col("v"))), 6).alias("top"), F.round(N.log_sum_exp(F.col("v")), 6).alias("lse"))


@query("m2_probability_forms", "SELECT l_orderkey, l_linenumber, round(ln(q / (1 - q)), 6) AS lg, round(1 / (1 + exp(-l_discount)), 6) AS sg, round(least(greatest(l_discount, 0.005), 0.995), 4) AS written FROM (SELECT *, least(greatest(l_discount, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS q FROM lineitem)")
def m2(spark, d):
    p = F.col("l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.logit(p), 6).alias("lg"), F.round(N.sigmoid(p), 6).alias("sg"), N.as_written(p).alias("written"))


_W = [((i * 7) % 5 - 2) / 4 for i in range(4)]


@query("m3_linear_head", "SELECT vec_id, round(1 / (1 + exp(-(" + " + ".join(f"embedding[{i + 1}]::DOUBLE * {w!r}::DOUBLE" for i, w in enumerate(_W)) + " + 0.1::DOUBLE))), 6) AS p FROM embeddings")
def m3(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(N.sigmoid(N.linear_head(F.slice("embedding", 1, 4), _W, 0.1)), 6).alias("p"))


@query("m4_z_scores", "SELECT i, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-6), 6) AS spread FROM (SELECT generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY i")
def m4(spark, d):
    rows = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "x")).select("i", F.col("x").cast("double").alias("x"))
    return rows.groupBy("i").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.greatest(F.stddev_pop("x"), F.lit(1e-6)), 6).alias("spread"))


@query("m5_spread", "SELECT p_partkey, round((1 - p) * 1 / 6, 6) AS a, round((1 - p) * 2 / 6, 6) AS b, round((1 - p) * 3 / 6, 6) AS c FROM (SELECT p_partkey, (p_size / 60.0)::DOUBLE AS p FROM part)")
def m5(spark, d):
    s = N.spread(F.col("p_size") / F.lit(60.0), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return table(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", *[F.round(F.get("s", F.lit(i)), 6).alias(k) for i, k in enumerate("abc")])


@query("m6_set_iou", "SELECT user_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS iou FROM (SELECT user_id, list(DISTINCT event_type) FILTER (value > 50) AS a, list(DISTINCT event_type) FILTER (value <= 50) AS b FROM events GROUP BY user_id) WHERE a IS NOT NULL AND b IS NOT NULL")
def m6(spark, d):
    sets = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") <= 50, F.col("event_type"))).alias("b"))
    return sets.where("size(a) > 0 and size(b) > 0").select("user_id", F.round(N.set_iou(F.col("a"), F.col("b")), 6).alias("iou"))


@query("m7_tolerant_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def m7(spark, d):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    bare = F.regexp_extract(fenced, r"(?s)(\{.*\})", 1)
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json(bare), "$.k", "string").alias("k"))


@query("m9_cosine", f"SELECT a.vec_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS cosine FROM (SELECT vec_id, {_E} AS v FROM embeddings) a JOIN (SELECT vec_id + 1 AS vec_id, {_E} AS v FROM embeddings) b ON a.vec_id = b.vec_id")
def m9(spark, d):
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(N.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))
