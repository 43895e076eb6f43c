import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gatherum.operators import graph as G
from gatherum.plans import sparql
from gatherum.sources import records as S
from gatherum.streaming import jobs

QUAD = "g string, s string, p string, o string, o_kind string, o_datatype string, o_lang string"
X = "http://x/"


@pytest.fixture
def quads(spark):
    t, lab = G.RDF_TYPE, X + "Label"
    rows = [(X + "g1", X + "a", t, lab), (X + "g2", X + "a", t, lab), (X + "g1", X + "b", t, lab)]
    rows = [(g, s, p, o, "iri", None, None) for g, s, p, o in rows]
    rows += [(X + "g1", X + "a", X + "p", "0.5", "literal", G.XSD + "decimal", None), (X + "g1", X + "b", X + "name", 'say "hi"\\\n', "literal", None, "de")]
    return spark.createDataFrame(rows, QUAD)


def test_forms(quads):
    q = "PREFIX x: <http://x/> "
    assert sparql.run(quads, q + "SELECT ?s { ?s a x:Label }").count() == 3
    assert sparql.run(quads, q + "SELECT DISTINCT ?s { ?s a x:Label }").count() == 2
    assert sparql.run(quads, q + "ASK { ?s x:p ?o }").first()["result"] is True
    assert sparql.run(quads, q + "SELECT ?s ?o { ?s a x:Label . OPTIONAL { ?s x:p ?o } FILTER(!BOUND(?o)) }").count() == 1
    assert sparql.run(quads, q + "SELECT ?s { GRAPH x:g1 { ?s ?p ?o } }").count() == 4
    assert [r["n"] for r in sparql.run(quads, q + "SELECT ?s (COUNT(DISTINCT ?p) AS ?n) { ?s ?p ?o } GROUP BY ?s ORDER BY DESC(?n)").collect()] == [2, 2]
    rows, cut = sparql.probe(quads, 5)
    assert rows.count() == 5 and not cut and sparql.probe(quads, 4)[1]


@pytest.mark.parametrize("text,code", [("SELECT ?s {", "syntax"), ("INSERT DATA { <a> <b> <c> }", "update_refused"), ("DROP ALL", "update_refused"), ("CONSTRUCT { ?s ?p ?o } { ?s ?p ?o }", "form_refused"), ("DESCRIBE <a>", "form_refused"), ("SELECT ?s { SERVICE <x> { ?s ?p ?o } }", "evaluation")])
def test_refusals(quads, text, code):
    with pytest.raises(sparql.Refused) as e:
        sparql.run(quads, text)
    assert e.value.code == code


def test_nquads_round_trip(quads):
    back = G.from_nquads(G.to_nquads(quads))
    got = sorted(map(str, back.drop("bad").collect()))
    assert got == sorted(map(str, quads.collect())) and back.where("bad").count() == 0


def test_isomorphism(spark):
    def tree(a, b, leaf):
        return spark.createDataFrame([(None, "_:" + a, X + "c", "_:" + b, "blank", None, None), (None, "_:" + b, X + "v", leaf, "literal", None, None)], QUAD)

    assert G.isomorphic(tree("a", "b", "1"), tree("z", "y", "1")).first()[0]
    assert not G.isomorphic(tree("a", "b", "1"), tree("z", "y", "2")).first()[0]


def test_ndjson(spark, tmp_path):
    (tmp_path / "f.json").write_text("\n".join([json.dumps({"id": 1, "k": "a"}), "{bad", json.dumps({"id": 2, "k": "b"}), ""]))
    schema = StructType([StructField("id", LongType()), StructField("k", StringType())])
    path = str(tmp_path / "f.json")
    assert S.read_ndjson(spark, path, schema, contains='"b"').select("id").collect()[0]["id"] == 2
    assert S.parse_errors(spark, path, schema).first()["errors"] == 1
    wanted = spark.createDataFrame([("2",)], "id string")
    assert [r["k"] for r in S.read_wanted(spark, path, schema, "id", wanted).collect()] == ["b"]
    (tmp_path / "c.csv").write_text("a,b,a\n1,2,3\n")
    assert S.read_csv(spark, str(tmp_path / "c.csv")).collect()[0].asDict() == {"a": "3", "b": "2"}


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(k % 3, k, ["queued", "running", "done", "running"][k // 3]) for k in range(12)]
    schema = "job long, seq long, state string"
    log = spark.createDataFrame(rows, schema)
    for part in range(2):
        log.where(F.floor(F.col("seq") / 6) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_events(spark, str(tmp_path / "in"), schema)
    q = jobs.state_stream(stream, "job", "state", "seq").writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["job"]: r["state"] for r in spark.sql("select job, max_by(state, events) state from states group by job").collect()}
    assert got == {r["job"]: r["state"] for r in jobs.job_states(log, "job", ["seq"], "state").collect()}
    timed = stream.withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    q = jobs.tumbling(timed, "ts", "5 minutes", [], late="1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [2, 5, 5]


@pytest.fixture
def people(spark):
    n, t = X + "name", G.RDF_TYPE
    lit = lambda s, p, o, d="string", lang=None: (X + "g", X + s, X + p, o, "literal", None if lang else G.XSD + d, lang)
    link = lambda s, p, o: (X + "g", X + s, X + p, X + o, "iri", None, None)
    rows = [(X + "g", X + s, t, X + "N", "iri", None, None) for s in ("a", "b")] + [lit("a", "size", "5", "integer"), lit("b", "word", "5"), lit("b", "word", "fünf", lang="de"), link("a", "knows", "b"), link("b", "knows", "c"), lit("c", "z", "5", "integer"), lit("d", "z", "6", "integer")]
    assert n
    return spark.createDataFrame(rows, QUAD)


def values(df):
    return sorted(tuple(r) for r in sparql.flat(df).collect())


def test_unbound_variables_are_compatible(people):
    q = "PREFIX x: <http://x/> "
    got = values(sparql.run(people, q + "SELECT ?n ?y { ?n a x:N OPTIONAL { ?n x:size ?s } ?y x:z ?s }"))
    assert got == [(X + "a", X + "c"), (X + "b", X + "c"), (X + "b", X + "d")]
    assert values(sparql.run(people, q + "SELECT ?n ?s { ?n a x:N OPTIONAL { ?n x:size ?s } OPTIONAL { ?n x:word ?s } }")) == [(X + "a", "5"), (X + "b", "5"), (X + "b", "fünf")]
    left = values(sparql.run(people, q + "SELECT ?n { ?n a x:N OPTIONAL { ?n x:size ?s } MINUS { ?n x:word ?s } }"))
    assert left == [(X + "a",)]  # b shares only ?n with what is taken away, and that is equal


def test_datatypes_and_languages(people):
    q = "PREFIX x: <http://x/> "
    count = lambda text: sparql.run(people, q + text).count()
    assert count("SELECT ?s { ?s ?p 5 }") == 2 and count('SELECT ?s { ?s ?p "5" }') == 1 and count('SELECT ?s { ?s ?p "5"^^<http://www.w3.org/2001/XMLSchema#integer> }') == 2
    assert count('SELECT ?s { ?s ?p "fünf"@de }') == 1 and count('SELECT ?s { ?s ?p "fünf" }') == 0
    assert count('SELECT ?v { ?s x:word ?v FILTER(LANG(?v) = "de") }') == 1 and count("SELECT ?v { ?s x:size ?v FILTER(DATATYPE(?v) = <http://www.w3.org/2001/XMLSchema#integer>) }") == 1


def test_order_of_patterns_makes_no_product(people):
    q = "PREFIX x: <http://x/> "
    df = sparql.run(people, q + "SELECT ?a ?c { ?a a x:N . ?c x:z ?v . ?b x:knows ?c . ?a x:knows ?b }")
    assert values(df) == [(X + "a", X + "c")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Cartesian" not in df._jdf.queryExecution().executedPlan().toString()


def test_paths_values_binds_and_sub_selects(people):
    q = "PREFIX x: <http://x/> "
    assert values(sparql.run(people, q + "SELECT ?a ?c { ?a x:knows/x:knows ?c }")) == [(X + "a", X + "c")]
    assert values(sparql.run(people, q + "SELECT ?a { x:b ^x:knows ?a }")) == [(X + "a",)]
    assert len(values(sparql.run(people, q + "SELECT ?a ?v { ?a x:z|x:size ?v }"))) == 3
    assert values(sparql.run(people, q + "SELECT ?a ?v { ?a x:z ?v VALUES (?a ?v) { (x:c UNDEF) (x:d 7) } }")) == [(X + "c", "5")]
    assert values(sparql.run(people, q + "SELECT ?a ?n { ?a x:word ?w BIND(STRLEN(STR(?w)) AS ?n) }")) == [(X + "b", "1"), (X + "b", "4")]
    assert values(sparql.run(people, q + "SELECT ?s ?n { ?s a x:N { SELECT ?s (COUNT(?o) AS ?n) { ?s ?p ?o } GROUP BY ?s HAVING(?n > 3) } }")) == [(X + "b", "4")]
    with pytest.raises(sparql.Refused):
        sparql.run(people, q + "SELECT ?a { ?a x:knows* ?b }")


def test_time_limit(spark, people):
    slow = spark.range(1).selectExpr("aggregate(sequence(1, 100000000), 0L, (a, b) -> a + b % 7) as x")
    rows, cut, late = sparql.probe_in_time(slow, 5, 0.5)
    assert late and not cut and rows.count() == 0
    rows, cut, late = sparql.probe_in_time(people, 5, 600)
    assert rows.count() == 5 and cut and not late


def test_trig(spark, people):
    from gatherum.sources import trig

    cols = people.columns
    back = trig.from_trig(trig.to_trig(people).withColumnRenamed("s", "subject"), "subject", "value")
    assert back.where("error is not null").count() == 0
    assert sorted(map(str, back.select(*cols).collect())) == sorted(map(str, people.select(*cols).distinct().collect()))
    with pytest.raises(trig.TrigError) as e:
        trig.parse_trig("@prefix x: <http://x/> .\nx:a x:b ,")
    assert (e.value.line, e.value.column) == (2, 9)


def test_yaml_records():
    from gatherum.sources import yaml_records as Y

    assert Y.parse_yaml('a: "x: y"\nb:\n- 1\n- null\nc:\n  d: true\n  e: []') == {"a": "x: y", "b": [1, None], "c": {"d": True, "e": []}}
    for bad in ("a b", "- 1", "a: 1\n    b: 2"):
        with pytest.raises(ValueError):
            Y.parse_yaml(bad)
