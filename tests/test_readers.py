import pytest
from pyspark.sql import functions as F

from gatherum.operators import documents as D
from gatherum.operators import readers as R
from gatherum.operators import sequence as Q
from gatherum.operators import tiers  # noqa: F401
from gatherum.plans import q_readers
from gatherum.plans.samples import Samples

PROPOSAL = "Kantonsrat\nGeschäft Nr. 2020.145\nMotion Anna Muster und Mitunterzeichnende betreffend sichere Schulwege\nEingereicht am: 12. März 2020\n\nDer Regierungsrat wird beauftragt, die Schulwege zu sichern.\n\nAltdorf, 10. März 2020\nDie Unterzeichnenden\nAnna Muster"
ANSWER = "Antwort des Gemeinderats auf die Interpellation von Beat Beispiel vom 3.4.2021\n\nDer Gemeinderat nimmt Stellung.\nSeedorf, 5. Mai 2021\nIm Namen des Gemeinderats"


@pytest.fixture(scope="module")
def values(spark):
    docs = spark.createDataFrame([(1, PROPOSAL, "proposal"), (2, ANSWER, "response"), (3, "", "other"), (4, None, None)], "doc_id long, text string, role string")
    lines = R.reader_lines(docs, Q.lines(docs.where("text is not null"), "doc_id", "text"))
    rows = R.read(lines, documents=docs).collect()
    return docs, {(r["doc_id"], r["field"]): r for r in rows}


@pytest.mark.parametrize("doc,field,tier,value", [
    (1, "affair_type", "type_line_start", "Motion"), (1, "affair_number", "number_cue_affair_line", "2020.145"), (1, "title", "cue_in_line", "sichere Schulwege"), (1, "submission_date", "sub_label_cue", "12. März 2020"),
    (1, "first_author", "type_full_name", "Anna Muster"), (1, "responder", "rsp_addressee_cue", "Regierungsrat"), (2, "affair_type", "type_response_phrase", "Interpellation"), (2, "responder", "rsp_response_cue", "Gemeinderat"),
    (2, "response_date", "resp_signature_date", "5. Mai 2021"), (2, "first_author", "response_head_prep_name", "Beat Beispiel"),
])
def test_tiers(values, doc, field, tier, value):
    r = values[1][(doc, field)]
    assert (r["tier"], r["value"]) == (tier, value)
    text = {1: PROPOSAL, 2: ANSWER}[doc]
    assert text[r["start"] : r["stop"]] == value


def test_not_found(values):
    assert values[1][(3, "title")]["reason"] == "no_text" and values[1][(2, "submission_date")]["found"] and not values[1][(4, "responder")]["found"]


def test_tier_names_are_unique(spark):
    rows = R.tier_table(spark).collect()
    assert len({(r["field"], r["tier"]) for r in rows}) == len(rows) > 130
    with pytest.raises(ValueError):
        R.register("title")(None)


def test_lines_are_read_once_for_all_fields(spark):
    docs = spark.createDataFrame([(1, PROPOSAL, "proposal")], "doc_id long, text string, role string")
    rows = R.read(R.reader_lines(docs, Q.lines(docs, "doc_id", "text")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan


def test_marks_hide_no_line_that_a_pattern_matches(spark, monkeypatch):
    samples = {row[1] for name, group in vars(q_readers).items() if isinstance(group, Samples) and group.inputs == q_readers._SCHEMA for row in group.rows}
    odd = ["Motıon Huber", "MOTİON Huber", "poſtulat 55/2019", "DÉPOSÉE PAR Anna Muster", "RÉPONSE du CONſEIL d'État", "ANFRAGE von Beat Beispiel", "+41 44 123 45 67", "a.b@c.ch"]
    docs = spark.createDataFrame([(k, t, role) for k, t in enumerate(sorted(samples) + odd + [PROPOSAL, ANSWER]) for role in ("proposal", "response", "other")], "k long, text string, role string")
    docs = docs.selectExpr("k * 3 + CASE role WHEN 'proposal' THEN 0 WHEN 'response' THEN 1 ELSE 2 END AS doc_id", "text", "role")
    lines = R.reader_lines(docs, Q.lines(docs, "doc_id", "text"))
    found = lambda: {tuple(r) for r in R._tier_rows(lines, R._TIERS).collect()}
    assert all(t.marks for t in R._TIERS["affair_number"]) and "answer" not in next(t for t in R._TIERS["responder"] if t.name == "rsp_response_cue").marks
    marked = found()
    monkeypatch.setattr(R.Tier, "marks", [])
    assert marked == found() and len({r[2] for r in marked}) > 80


def test_marks_of_roles_hide_no_line(spark):
    said = ["PROTOKOLL", "procès-verbal", "Verbale", "wırd beauftragt", "EST CHARGÉ", "è incaricato", "Begrundung", "BEGRÜNDUNG", "Développement", "DÉPOSÉ PAR", "les souſsignés", "PRESENTATO DA", "firmatari", "Unterzeichnende", "eingereicht von", "MOTİON", "Poſtulat", "interpellanza", "nichts"]
    lines = spark.createDataFrame([(k, 0, t) for k, t in enumerate(said)], "doc_id long, line int, text string")
    rows = lines.join(D.role_features(lines), "doc_id").select("text", "protocol_head", *[F.col(c) > 0 for c in ("demand_marks", "sponsor_marks", "proposal_words")], *[F.col("text").rlike(p) for p in (D.PROTOCOL, D.DEMAND, D.SPONSOR, D.PROPOSAL)]).collect()
    assert all(r[1:5] == r[5:] for r in rows) and sum(any(r[1:5]) for r in rows) == len(said) - 1
