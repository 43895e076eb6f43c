"""Queries: the readers of the head values over documents that hit their tiers; values are written out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatherum.operators import readers as R
from gatherum.operators import sequence as Q
from gatherum.operators import tiers  # noqa: F401  registers the readers
from gatherum.plans.registry import query, table
from gatherum.plans.samples import Samples

_SCHEMA, _RESULT = "role string, lines string", ("tier", "value", "reason")


def _documents(*rows):
    return Samples(_SCHEMA, _RESULT, [r if len(r) == 5 else (*r, None) for r in rows])


def _read(spark, d, samples, field):
    docs = samples.over(table(spark, d, "customer"), "c_custkey").withColumnRenamed("c_custkey", "doc_id")
    lines = R.reader_lines(docs.select("doc_id", "role"), Q.lines(docs, "doc_id", "lines"))
    return R.read(lines, [field], docs).select(F.col("doc_id").alias("c_custkey"), "tier", "value", "reason")


_FILL = "\n" * 16
_TYPES = _documents(
    ("proposal", "Vorstossart: Motion", "type_cue_label", "Motion"), ("proposal", "[x] Postulat", "type_checkbox", "Postulat"), ("proposal", "■ Motion", "type_checkbox_odd_mark", "Motion"), ("proposal", "Motion Meier", "type_line_start", "Motion"), ("response", "Antwort auf die Interpellation Huber", "type_response_phrase", "Interpellation"),
    ("proposal", _FILL + "Motion Meier", "type_line_start_late", "Motion"), ("response", _FILL + "Antwort auf die Motion", "type_response_phrase_late", "Motion"), ("proposal", "Nr. 12/2020 Motion", "type_head_inline", "Motion"), ("other", "Der Rat hat folgende Motion erhalten", "type_submission_phrase", "Motion"),
    ("other", "Text zum Postulat hier", "type_head_inline_text", "Postulat"), ("other", "Botschaft", "type_government_head", "Botschaft"), ("other", "Antrag an den Landrat", "type_government_phrase", "Antrag an den"), ("other", "Ohne Angabe", None, None, "no_candidate"), ("other", " \n ", None, None, "no_text"),
    ("proposal", "Postulat\nVorstossart: Motion", "type_cue_label", "Motion"),
)


@query("d16_read_type", _TYPES.sql("customer", "c_custkey"))
def d16(spark, d):
    return _read(spark, d, _TYPES, "affair_type")


_NUMBERS = _documents(
    ("other", "Geschäft Nr. 12.345", "number_cue_affair_line", "12.345"), ("other", "Geschäftsnummer:\n2020/15", "number_cue_affair_below", "2020/15"), ("other", "GR Nr. 2019/55", "number_cue_council", "2019/55"), ("other", "Text 2020.RRGR.12", "number_form_year_letters", "2020.RRGR.12"), ("other", "Reg. Nr. 12-34.567.01", "number_docpart_cue", "12-34.567.01"),
    ("other", "Vorstoss-Nr.: 123-2020", "number_cue_intervention_line", "123-2020"), ("other", "Vorstoss-Nr.\n123-2020", "number_cue_intervention_below", "123-2020"), ("proposal", "Motion Nr. 12/2019", "number_type_cue", "12/2019"), ("proposal", "Motion 55/2019", "number_type_adjacent", "55/2019"), ("proposal", "Motion Meier betreffend Wege (12-345)", "number_type_paren", "12-345"),
    ("other", "Nr. 55/2020", "number_bare_nr", "55/2020"), ("other", "19.3456 Wege bauen", "number_line_dotted", "19.3456"), ("other", "M 12/2020", "number_line_form", "M 12/2020"), ("other", "Präsidial-Nr. A123456", "number_letter_code_cue", "A123456"), ("other", "Laufnummer: 4711", "number_cue_running_footer", "4711"),
    ("other", "zu den Akten 33/2018", "number_cue_file", "33/2018"), ("other", "Interpellation zu Wegen, siehe (AB 1234)", "number_paren_code", "AB 1234"), ("other", "Motion 12.03.2019", None, None, "date"), ("other", "RRB Nr. 55/2020 vom Montag", None, None, "no_candidate"), ("other", "Geschäft Nr. 3/14", "number_cue_affair_line", "3/14"),
    ("other", "Geschäft 2019", "number_cue_affair_digits", "2019", None), ("other", "Ohne", None, None, "no_candidate"), ("other", "", None, None, "no_text"),
)


@query("d17_read_number", _NUMBERS.sql("customer", "c_custkey"))
def d17(spark, d):
    return _read(spark, d, _NUMBERS, "affair_number")


_TITLES = _documents(
    ("proposal", "Titel: Wege bauen", "label_cue", "Wege bauen"), ("proposal", "Titel Wege für alle bauen", "label_no_colon", "Wege für alle bauen"), ("proposal", "Titel\nWege bauen", "label_stack_last", "Wege bauen"), ("proposal", "betreffend Wege bauen", "cue_line", "Wege bauen"), ("proposal", "Text und anderes betreffend Wege", "cue_in_line", "Wege"),
    ("proposal", "19.3456 Wege bauen", "number_line_title", "Wege bauen"), ("proposal", "Motion Meier; Wege bauen; Antwort", "type_semicolon", "Wege bauen"), ("proposal", "- Motion Wege bauen", "type_list_item", "Wege bauen"), ("proposal", "Motion Meier «Wege bauen»", "type_quoted", "Wege bauen"), ("proposal", "Motion Meier: Wege bauen", "type_colon", "Wege bauen"),
    ("proposal", "Motion\nWege für alle", "after_type_heading", "Wege für alle"), ("other", "mit dem Titel «Wege bauen» kam", "sentence_titled_quote", "Wege bauen"), ("other", "x", None, None, "no_candidate"), ("proposal", "betreffend Wege\nTitel: Strassen", "cue_line", "Wege"),
)


@query("d19_read_title", _TITLES.sql("customer", "c_custkey"))
def d19(spark, d):
    """The first line with a title decides, then the tier."""
    return _read(spark, d, _TITLES, "title")


_SUBMITTED = _documents(
    ("proposal", "Eingereicht am: 3. Mai 2020", "sub_label_cue", "3. Mai 2020"), ("proposal", "Eingereicht:\n3.5.2020", "sub_label_table", "3.5.2020"), ("response", "Eingereicht am 3.5.2020", "sub_label_cue_resp", "3.5.2020"), ("proposal", "Motion Meier vom 3. Mai 2020", "sub_type_date_near", "3. Mai 2020"),
    ("response", "Antwort auf die Motion Meier vom 3. Mai 2020", "sub_resp_head_near", "3. Mai 2020"), ("proposal", "Bern, den 3. Mai 2020\nDie Unterzeichnenden", "sub_signers_date", "3. Mai 2020"), ("other", "Am 3. Mai 2020 reichte sie es ein, am 3. Mai 2020 wurde es eingereicht", "sub_sentence_cue", "3. Mai 2020"),
    ("proposal", "Bern, 3. Mai 2020", "sub_letter_head", "3. Mai 2020"), ("proposal", "3. Mai 2020", "sub_head_date_line", "3. Mai 2020"), ("other", "Bericht und Antrag vom 3. Mai 2020", "sub_dispatch_date", "3. Mai 2020"), ("other", "Bern, 3. Mai 2020", "sub_dispatch_letter", "3. Mai 2020"), ("other", "Text", None, None, "no_candidate"),
)


@query("d20_read_submission_date", _SUBMITTED.sql("customer", "c_custkey"))
def d20(spark, d):
    return _read(spark, d, _SUBMITTED, "submission_date")


_ANSWERED = _documents(
    ("response", "Antwort des Regierungsrates vom 3. Mai 2020", "resp_cue_date", "3. Mai 2020"), ("response", "approuvé par le Conseil municipal le 3 mai 2020", "resp_approval_date", "3 mai 2020"), ("response", "RRB vom 3. Mai 2020", "resp_decision_date", "3. Mai 2020"), ("response", "Sitzung vom 3. Mai 2020", "resp_minute_head", "3. Mai 2020"),
    ("response", "Antwort\nvom 3. Mai 2020", "resp_heading_date", "3. Mai 2020"), ("response", "Bern, 3. Mai 2020\nIm Namen des Regierungsrates", "resp_signature_date", "3. Mai 2020"), ("response", "Bern, 3. Mai 2020", "resp_letter_head", "3. Mai 2020"), ("response", "3. Mai 2020", "resp_page1_date_line", "3. Mai 2020"), ("other", "siehe Stellungnahme des Amtes vom 3. Mai 2020", "resp_cited_date", "3. Mai 2020"), ("other", "Text", None, None, "no_candidate"),
)


@query("d21_read_response_date", _ANSWERED.sql("customer", "c_custkey"))
def d21(spark, d):
    return _read(spark, d, _ANSWERED, "response_date")


_RESPONDERS = _documents(
    ("response", "Antwort des Regierungsrates", "rsp_response_cue", "Regierungsrat"), ("response", "Im Namen des Gemeinderates", "rsp_signature", "Gemeinderat"), ("response", "Bern, 3. Mai 2020\nDer Stadtrat", "rsp_signature_place", "Stadtrat"), ("other", "Auszug aus dem Protokoll des Stadtrates", "rsp_minute_cue", "Stadtrat"), ("other", "Regierungsratsbeschluss", "rsp_decision_body", "Regierungsrat"),
    ("response", "Der Stadtrat", "rsp_letter_head", "Stadtrat"), ("response", "Es sagt der Gemeinderat dazu", "rsp_response_block", "Gemeinderat"), ("other", "Der Bundesrat wird gebeten", "rsp_addressee_cue", "Bundesrat"), ("proposal", "Siehe Antwort des Stadtrates", "rsp_response_text", "Stadtrat"), ("other", "Text", None, None, "no_candidate"),
)


@query("d22_read_responder", _RESPONDERS.sql("customer", "c_custkey"))
def d22(spark, d):
    return _read(spark, d, _RESPONDERS, "responder")


_AUTHORS = _documents(
    ("proposal", "Eingereicht von: Anna Meier", "label_same_line", "Anna Meier"), ("proposal", "Motion von Anna Meier", "type_prep_name", "Anna Meier"), ("response", "Antwort auf die Motion von Anna Meier", "response_head_prep_name", "Anna Meier"), ("proposal", "Motion Fraktion (Anna Meier)", "type_group_bracket", "Anna Meier"), ("proposal", "Motion betreffend Wege; Anna Meier", "type_separator_name", "Anna Meier"),
    ("proposal", "Eingereicht von:\nAnna Meier", "label_next_lines", "Anna Meier"), ("other", "Herrn\nPeter Huber", "addressee_member", "Peter Huber"), ("proposal", "Anna Meier", "sender_signature", "Anna Meier"), ("proposal", "Motion Meier (SP)", "type_entry_name", "Meier"), ("proposal", "Motion Anna Meier betreffend Wege", "type_full_name", "Anna Meier"),
    ("other", "Frau Anna Meier", "addressee_reply", "Anna Meier"), ("other", "Es reichte Kantonsrätin Anna Meier ein", "narrative_submit", "Anna Meier"), ("other", "Anna Meier, SP", "head_sender_marked", "Anna Meier"), ("proposal", "Motion Meier: Wege", "type_family_name", "Meier"), ("other", "kein name", None, None, "no_candidate"),
)


@query("d23_read_author", _AUTHORS.sql("customer", "c_custkey"))
def d23(spark, d):
    return _read(spark, d, _AUTHORS, "first_author")


_CAUSES = Samples("line string, value string", ("cause",), [
    ("am 3. Mai 2020 kam", "2020", "date"), ("Tel. 031 123 45 67", "031 123 45 67", "phone"), ("SR 101.1", "101.1", "law_number"), ("CHF 1200", "1200", "amount"), ("total 1200 Franken", "1200", "amount"), ("Seite 12", "12", "page_number"), ("3/14", "3/14", "page_number"), ("3000 Bern", "3000", "postal_code"), ("in 2019", "2019", "year"),
    ("RRB Nr. 815", "815", "decision_number"), ("RRB 4 zu 815", "815", None), ("Geschäft 12.345", "12.345", None),
])


@query("d17_refusal_causes", _CAUSES.sql("customer", "c_custkey"))
def d17_causes(spark, d):
    rows = _CAUSES.over(table(spark, d, "customer"), "c_custkey").withColumn("at", F.expr("locate(value, line)") - 1)
    return rows.select("c_custkey", tiers.number_refusal(F.col("line"), F.col("value"), F.col("at")).alias("cause"))


@query("u2_reader_modules", "SELECT 'tiers' AS module, 8::BIGINT AS n_fields")
def u2(spark, d):
    """Modules whose readers register themselves when they are found."""
    found = R.discover("gatherum.operators")
    return spark.createDataFrame([(m, len(R.fields())) for m in found], "module string, n_fields long")


@query("u4_error_policy", "SELECT c_custkey, field, reason FROM customer, (VALUES ('affair_type', 'no_candidate'), ('broken', 'reader_error'), ('unheard_of', 'no_reader')) v(field, reason)")
def u4(spark, d):
    """A reader that fails leaves a reason, and the other fields are read; asked to be strict, it fails."""
    def broken(lines):
        raise ValueError("a reader that fails")

    R._READERS["broken"] = broken
    try:
        docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("other").alias("role"), F.lit("plain text").alias("lines"))
        lines = R.reader_lines(docs.select("doc_id", "role"), Q.lines(docs, "doc_id", "lines"))
        return R.read(lines, ["affair_type", "broken", "unheard_of"], docs, strict=False).select(F.col("doc_id").alias("c_custkey"), "field", "reason")
    finally:
        del R._READERS["broken"]


@query("u5_rule_tables", "SELECT 'affair_type' AS field, 15::BIGINT AS n UNION ALL SELECT 'affair_number', 43 UNION ALL SELECT 'title', 19 UNION ALL SELECT 'submission_date', 19 UNION ALL SELECT 'response_date', 12 UNION ALL SELECT 'responder', 12 UNION ALL SELECT 'first_author', 22 UNION ALL SELECT 'contact', 2")
def u5(spark, d):
    """Rule tables as rows: how many tiers each field has; names differ and ranks count from 1."""
    t = R.tier_table(spark)
    return t.groupBy("field").agg(F.when((F.count_distinct("tier") == F.max("tier_rank")) & (F.min("tier_rank") == 1), F.count("*")).alias("n"))
