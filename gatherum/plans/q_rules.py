"""Queries: rule tables and parts of documents over rows that hit every rule; their results are written out by hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatherum.functions import dates as D
from gatherum.functions import text as T
from gatherum.operators import documents as O
from gatherum.operators import parts as A
from gatherum.operators import register as G
from gatherum.operators import rules as R
from gatherum.plans.registry import dealt, query, table
from gatherum.plans.samples import Samples

_CLASSES = Samples("name string", ("name_class",), [
    ("Antwort des Regierungsrates", "antwort"), ("Réponse du Conseil d'Etat", "antwort"), ("RRB 12/2020", "antwort"), ("Dringliche Motion", "vorstoss"), ("Interrogazione", "vorstoss"), ("Wortlaut", "vorstoss"),
    ("Botschaft und Entwurf", "bericht_vorlage"), ("Messaggio", "bericht_vorlage"), ("Dekret", "beschluss"), ("Décision", "beschluss"), ("Procès-verbal", "protokoll"), ("Bulletin", "protokoll"),
    ("Beilage 3", "beilage"), ("Allegato", "beilage"), ("  ", "leer"), (None, "leer"), ("Foto", "andere"), ("Motion und Antwort", "antwort"), ("frage", "vorstoss"), ("Umfrage", "andere"),
])


@query("p3_name_class", _CLASSES.sql("customer", "c_custkey"))
def p3(spark, d):
    return _CLASSES.over(table(spark, d, "customer"), "c_custkey").select("c_custkey", R.classify(F.col("name"), R.NAME_CLASSES, "leer", "andere").alias("name_class"))


_SPONSORS = Samples("role string, de string, fr string", ("class",), [
    ("cosign", "Urheber", None, "cosponsor"), ("co-signer", None, None, "cosponsor"), ("assuming", None, None, "transferred"), ("primary", "Kommission", None, "sponsor"), ("party-group", None, None, "sponsor"), ("multigroup", None, None, "sponsor"),
    ("interpartis", None, None, "sponsor"), ("speaker", "Urheber", None, "andere"), (None, "Urheber", None, "andere"), ("author", None, None, "unbestimmt"), ("author", "", " ", "unbestimmt"), ("author", "Übernommen von", None, "transferred"),
    ("author", None, "Repris par", "transferred"), ("author", "Mitunterzeichnerin", None, "cosponsor"), ("author", None, "Co-auteur", "cosponsor"), ("author", "Berichterstatter", None, "andere"), ("author", "Urheber", "Commission", "andere"),
    ("author", "Erstunterzeichner", None, "sponsor"), ("author", None, "Auteur", "sponsor"), ("author", "Unterzeichner", None, "unbestimmt"), ("author", "Gast", None, "unbestimmt"), ("author", "Motionärin", None, "sponsor"),
])


@query("p6_sponsor_class", _SPONSORS.sql("customer", "c_custkey"))
def p6(spark, d):
    return _SPONSORS.over(table(spark, d, "customer"), "c_custkey").select("c_custkey", G.sponsor_class(F.col("role"), F.col("de"), F.col("fr")).alias("class"))


_TEXT_TYPES = Samples("de string, fr string, it string", ("value", "match"), [
    ("Titel des Geschäfts", None, None, "title", "exakt"), (None, "Titre de l'objet", None, "title", "exakt"), ("Eingereichter Text", None, None, "submitted", "exakt"), ("Vorstoss", None, None, "submitted", "exakt"), ("Frage vom 3. Mai", None, None, "submitted", "exakt"),
    ("Antrag", None, None, "submitted", "nah"), ("Antrag und Beilage", None, None, "", "keine"), ("Begründung", None, None, "reasoning", "exakt"), (None, None, "Motivazione", "reasoning", "exakt"), ("Antwort des Rates", None, None, "response", "exakt"),
    (None, "Résumé", None, "summary", "nah"), ("Beschreibung", None, None, "summary", "weiter"), ("Unbekannt", "Contenu", None, "summary", "weiter"), (None, None, None, "", "keine"), ("", "Réponse", "Motivazione", "response", "exakt"), ("Lead", "Réponse", None, "summary", "nah"),
])


@query("p7_text_type", _TEXT_TYPES.sql("customer", "c_custkey"))
def p7(spark, d):
    found = _TEXT_TYPES.over(table(spark, d, "customer"), "c_custkey").withColumn("t", G.text_type(F.col("de"), F.col("fr"), F.col("it")))
    return found.select("c_custkey", "t.value", "t.match")


_RECOMMENDED = Samples("sentence string", ("recommendation",), [
    ("Annahme der Ziffern 1 und 2", "partial_acceptance"), ("Punkt 3 sei umzuwandeln", "partial_acceptance"), ("Die Motion sei in ein Postulat umzuwandeln", "partial_acceptance"), ("Als Postulat entgegennehmen", "partial_acceptance"),
    ("Sie ist als erfüllt abzuschreiben", "already_done"), ("Er beantragt die Abschreibung", "already_done"), ("Der Rat beantragt, die Ablehnung", "reject"), ("Er beantragt, die Motion abzulehnen", "reject"), ("Le conseil propose le rejet", "reject"),
    ("Nichtentgegennahme", "reject"), ("Der Rat beantragt die Annahme", "accept"), ("Er ist bereit, das Postulat entgegenzunehmen", "accept"), ("Acceptation du postulat", "accept"), ("Entgegennahme", "accept"), ("Er dankt", ""), ("", ""),
])


@query("p8_recommendation", _RECOMMENDED.sql("customer", "c_custkey"))
def p8(spark, d):
    return _RECOMMENDED.over(table(spark, d, "customer"), "c_custkey").select("c_custkey", G.recommendation(F.col("sentence")).alias("recommendation"))


_R, _P, _V = "ResponseStep", "PlenaryDebate", "SubmissionValidationStep(urgency_request)"
_EVENTS = Samples("harmonised int, title string", (*G.EVENT, "recommendation", "source"), [
    (None, "Der Bundesrat beantragt die Ablehnung der Motion.", _R, "executive_response", "recommended_against", "open", "reject", "lokal"), (None, "Der Bundesrat beantragt die Annahme der Motion.", _R, "executive_response", "recommended_for", "open", "accept", "lokal"),
    (None, "Der Regierungsrat ist bereit, es als Postulat entgegenzunehmen", _R, "executive_response", "keine:empfehlung_partial_acceptance", "open", "partial_acceptance", "lokal"), (None, "Der Stadtrat beantragt die Abschreibung", _R, "executive_response", "keine:empfehlung_already_done", "open", "already_done", "lokal"),
    (None, "Der Regierungsrat beantragt: annehmen und abschreiben", _R, "executive_response", "recommended_for", "open", "already_done", "lokal"), (29, "Stellungnahme Regierungsrat", _R, "executive_response", "recommended_against", "open", "reject", "lokal"),
    (None, "Stellungnahme Regierungsrat", _R, "executive_response", "", "open", "", "lokal"), (None, "Kommissionsantrag", "CommitteeDeliberationStep", "committee", "", "open", "", "lokal"), (None, "Dringlichkeit abgelehnt", _V, "urgency_review", "urgency_denied", "", "", "lokal"),
    (None, "Urgence acceptée", _V, "urgency_review", "urgency_granted", "", "", "lokal"), (None, "Dringlicherklärung, beantragt", _V, "urgency_review", "", "", "", "lokal"), (None, "Zurückgezogen", "Submission.withdrawn_date", "withdrawal", "withdrawn", "closed", "", "lokal"),
    (None, "Abschreibungsantrag", "ResponseStep(Abschreibungsantrag)", "report_submitted_to_council", "", "open", "", "lokal"), (None, "Nicht abgeschrieben", _P, "report_review_in_council", "keine:nichtabschreibung", "open", "", "lokal"),
    (None, "Abgeschrieben", "PlenaryDebate(abschreibung)", "report_review_in_council", "keine:abgeschrieben", "closed", "", "lokal"), (None, "Umwandlung in Postulat", _P, "forwarded_to_executive", "keine:als_postulat", "open", "", "lokal"), (None, "Abgelehnt", _P, "plenary", "rejected", "closed", "", "lokal"),
    (None, "Zur Stellungnahme", "AssignmentStep(executive_routing)", "", "", "open", "", "lokal"), (None, "Überwiesen an den Bundesrat", _P, "forwarded_to_executive", "adopted", "open", "", "lokal"), (None, "Zuweisung an die Sachkommission", "AssignmentStep(committee_referral)", "committee", "", "open", "", "lokal"),
    (None, "Überweisung an die Kommission", "AssignmentStep(committee_referral)", "committee", "", "open", "", "lokal"), (None, "Beratung in Kommission", "CommitteeDeliberationStep", "committee", "", "open", "", "lokal"), (None, "Annahme", _P, "plenary", "adopted", "", "", "lokal"),
    (None, "Eingereicht", "Submission", "submission", "none", "open", "", "lokal"), (None, "Réponse du Conseil", _R, "executive_response", "", "", "", "lokal"), (None, "Bericht zur Umsetzung", "ResponseStep(Bericht)", "report_submitted_to_council", "", "open", "", "lokal"),
    (None, "Kenntnisnahme", _P, "report_review_in_council", "keine:kenntnisnahme", "", "", "lokal"), (None, "Fristverlängerung", "PlenaryDebate(fristverlaengerung)", "", "keine:fristverlaengerung", "open", "", "lokal"), (None, "Diskussion verschoben", "PlenaryDebate(verzoegerung)", "plenary", "", "open", "", "lokal"),
    (None, " Erledigt", "ProcedureState", "", "", "closed", "", "lokal"), (None, "Im Rat noch nicht behandelt", "ProcedureState", "", "", "open", "", "lokal"), (None, "Differenzbereinigung", _P, "plenary", "", "", "", "lokal"), (None, "Traktandiert", "AssignmentStep(agenda_placement)", "", "", "open", "", "lokal"),
    (None, "Wird übernommen", "Submission.sponsorship(transferred)", "", "", "", "", "lokal"), (None, "Von beiden Räten behandelt", _P, "plenary", "", "", "", "lokal"), (35, "Etwas anderes", _P, "plenary", "rejected", "closed", "", "harmonisiert"),
    (40, "", "Submission.withdrawn_date", "withdrawal", "withdrawn", "closed", "", "harmonisiert"), (31, None, _R, "executive_response", "recommended_for", "open", "already_done", "harmonisiert"), (None, "Etwas anderes", "", "", "", "", "", ""), (999, "Etwas anderes", "", "", "", "", "", ""),
    (3, "x", "", "", "", "", "", "harmonisiert"), (33, "Etwas", _R, "executive_response", "keine:umwandlung_postulat_beantragt", "open", "partial_acceptance", "harmonisiert"), (None, None, "", "", "", "", "", ""),
])


@query("p9_event_class", _EVENTS.sql("events", "event_id"))
def p9(spark, d):
    return _EVENTS.over(table(spark, d, "events"), "event_id").withColumn("e", G.event_class(F.col("harmonised"), F.col("title"))).select("event_id", "e.*")


_CORRECTED = Samples("harmonised int, kind string", ("step", "stage", "decision", "status"), [
    (26, "motion", _P, "forwarded_to_executive", "adopted", "open"), (26, "interpellation", "AssignmentStep(executive_routing)", "", "", "open"), (80, "request", "AssignmentStep(executive_routing)", "", "", "open"), (27, "question", "AssignmentStep(executive_routing)", "", "", "open"),
    (35, "question", _P, "plenary", "rejected", "closed"), (26, None, _P, "forwarded_to_executive", "adopted", "open"),
])


@query("p10_type_dependent_correction", _CORRECTED.sql("events", "event_id"))
def p10(spark, d):
    event = G.event_for_type(G.event_class(F.col("harmonised"), F.lit(None).cast("string")), F.col("kind"))
    return _CORRECTED.over(table(spark, d, "events"), "event_id").withColumn("e", event).select("event_id", "e.step", "e.stage", "e.decision", "e.status")


_STATES = Samples("name string", ("status", "stage", "decision"), [
    ("Nicht erledigt", "open", "", ""), ("en cours", "open", "", ""), ("Als Postulat überwiesen und abgeschrieben", "closed", "report_review_in_council", "keine:abgeschrieben"), ("Als Postulat überwiesen", "open", "forwarded_to_executive", "keine:als_postulat"),
    ("Überwiesen", "open", "forwarded_to_executive", "adopted"), ("Retiré", "closed", "withdrawal", "withdrawn"), ("Classé", "closed", "report_review_in_council", "keine:abgeschrieben"), ("Abgelehnt", "closed", "plenary", "rejected"), ("Approvato", "", "plenary", "adopted"),
    ("Erledigt", "closed", "", ""), ("Liquidé", "closed", "", ""), ("Sonstiges", "", "", ""), ("", "", "", ""), (None, "", "", ""), ("erheblich", "open", "forwarded_to_executive", "adopted"), ("nicht erheblich", "closed", "plenary", "rejected"),
])


@query("p11_status_rules", _STATES.sql("orders", "o_orderkey"))
def p11(spark, d):
    return _STATES.over(table(spark, d, "orders"), "o_orderkey").withColumn("s", G.state_class(F.col("name"))).select("o_orderkey", "s.*")


_ORGANS = Samples("harmonised string, category string", ("role", "source"), [
    ("submitted_text", "Antwort", "vorstoss_eingereicht", "harmonisiert"), ("response_text", None, "antwort_exekutive", "harmonisiert"), ("agenda", "Antwort", "andere", "harmonisiert"), (None, "", "ohne_kategorie", "-"), (None, None, "ohne_kategorie", "-"),
    (None, "Antwort auf Petition", "andere", "stichwort"), (None, "Antwort", "antwort_exekutive", "stichwort"), ("unknown", "Stellungnahme", "antwort_exekutive", "stichwort"), (None, "RRB", "exekutivbeschluss", "stichwort"), (None, "Beschluss Stadtrat", "exekutivbeschluss", "stichwort+organ"),
    (None, "Beschluss Stadtrat und Parlament", "andere", "stichwort"), (None, "Beschluss", "andere", "stichwort"), (None, "Motion", "vorstoss_eingereicht", "stichwort"), (None, "Foto", "andere", "stichwort"),
])


@query("p14_role_by_organ", _ORGANS.sql("part", "p_partkey"))
def p14(spark, d):
    known = {"submitted_text": "vorstoss_eingereicht", "response_text": "antwort_exekutive", "government_resolution": "exekutivbeschluss", "agenda": "andere"}
    organs = lambda *names: F.array(*map(F.lit, names))
    role = G.document_role(F.col("harmonised"), F.col("category"), known, "petition", "antwort|stellungnahme", r"\brrb\b", "beschluss|d[ée]cision", "motion|postulat", organs("Stadtrat", "Regierungsrat", ""), organs("Parlament"))
    return _ORGANS.over(table(spark, d, "part"), "p_partkey").withColumn("r", role).select("p_partkey", "r.role", "r.source")


_URLS = Samples("url string", ("ext",), [
    ("https://a.ch/x/File.PDF", "pdf"), ("https://a.ch/x.docx?y=z.pdf", "docx"), ("https://a.ch/x.html#top.zip", "html"), ("https://a.ch", ""), ("https://a.ch/", ""), ("https://a.ch/x.tar.gz", "gz"), ("https://a.ch/x.toolong", ""), ("x/y.7z", "7z"), (None, None),
])


@query("p15_url_extension", _URLS.sql("pages", "page_id"))
def p15(spark, d):
    return _URLS.over(table(spark, d, "pages"), "page_id").select("page_id", R.url_extension(F.col("url")).alias("ext"))


_DAYS = Samples("day string", ("there", "reader", "register"), [
    ("2020-01-05T10:00:00", True, None, "2020-01-05"), ("2020-01-05", True, "2020-01-05", "2020-01-05"), (" 2020-01-05 ", True, None, "2020-01-05"), ("1900-01-01", True, "1900-01-01", None), ("2020-02-30", True, None, None), ("", False, None, None), ("  ", False, None, None), (None, False, None, None), ("5.1.2020", True, None, None),
])


@query("p20_day_of_text", _DAYS.sql("orders", "o_orderkey"))
def p20(spark, d):
    day = F.col("day")
    return _DAYS.over(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", T.present(day).alias("there"), D.reader_day(day).cast("string").alias("reader"), D.register_day(day).cast("string").alias("register"))


@query("p24_value_presence", "SELECT c_custkey, c_custkey % 4 IN (0, 3) AS there, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 3 THEN c_name END AS value FROM customer")
def p24(spark, d):
    k = F.col("c_custkey") % 4
    v = F.when(k == 0, F.col("c_name")).when(k == 1, "  ").when(k == 3, F.concat(F.lit(" "), "c_name", F.lit(" ")))
    return table(spark, d, "customer").select("c_custkey", T.present(v).alias("there"), T.blank_to_null(v).alias("value"))


# ---- text


_FORMS = Samples("text string", ("form", "offsets"), [
    ("Über  die Straße", "uber die strasse", "0,1,2,3,4,6,7,8,9,10,11,12,13,14,14,15"), ("e\u0301t\u00e9", "ete", "0,2,3"), ("a\u00adb", "ab", "0,2"), ("", "", ""), ("\u201ex\u201c \u2013 y", "\"x\" - y", "0,1,2,3,4,5,6"), (" \t\n", " ", "0"), ("\ufb01n", "fin", "0,0,1"), ("A\u00a0B", "a b", "0,1,2"),
])


@query("f3_search_map", _FORMS.sql("customer", "c_custkey"))
def f3(spark, d):
    rows = _FORMS.over(table(spark, d, "customer"), "c_custkey").withColumn("m", T.search_map("text"))
    return rows.select("c_custkey", F.col("m.text").alias("form"), F.array_join(F.transform("m.offsets", lambda x: x.cast("string")), ",").alias("offsets"))


_NAMES = Samples("short string, long string", ("part",), [
    ("Meier Huber", "Anna Meier Huber", True), ("Meier", "Anna Meier Huber", True), ("Anna Huber", "Anna Meier Huber", False), ("Huber Meier", "Anna Meier Huber", False), ("", "Anna", False), ("Anna Meier Huber Senn", "Anna Meier Huber", False), ("MÜLLER", "Jürg Müller", True), ("Anna", "", False),
])


@query("f9_part_of_list", _NAMES.sql("customer", "c_custkey"))
def f9(spark, d):
    return _NAMES.over(table(spark, d, "customer"), "c_custkey").select("c_custkey", T.is_part(T.words_of(F.col("short")), T.words_of(F.col("long"))).alias("part"))


_SENTENCES = Samples("text string", ("sentences",), [
    ("Es regnet. Wir gehen heim.", "Es regnet.|Wir gehen heim."), ("Gemäss Art. Fünf gilt es. Gut!", "Gemäss Art. Fünf gilt es.|Gut!"), ("Am 3. Mai kam A. Meier an. Ja? Nein.", "Am 3. Mai kam A. Meier an.|Ja?|Nein."), ("klein. weiter unten", "klein. weiter unten"), ("", ""),
    ("«Gut!» «Ja.» Ende.", "«Gut!» «Ja.» Ende."), ("Ende. «Neu» beginnt. Schluss", "Ende.|«Neu» beginnt.|Schluss"),
])


@query("f13_sentences", _SENTENCES.sql("customer", "c_custkey"))
def f13(spark, d):
    return _SENTENCES.over(table(spark, d, "customer"), "c_custkey").select("c_custkey", F.array_join(T.sentences(F.col("text")), "|").alias("sentences"))


_UNSPACED = Samples("text string", ("sentences",), [
    ("Es ist zu Ende.Am Tag danach. Es ging", "Es ist zu Ende.|Am Tag danach. Es ging"), ("Name-St.Gallen und www.Seite.Am/x, Dr.Muster", "Name-St.Gallen und www.Seite.Am/x, Dr.Muster"), ("Frage?Antwort!Ja", "Frage?|Antwort!|Ja"), ("A.Meier sagt es.Gut", "A.Meier sagt es.|Gut"), ("Datei.Pdf an a.b@c.De.Ja", "Datei.|Pdf an a.b@c.De.Ja"), ("", ""),
])


@query("f14_sentences_without_space", _UNSPACED.sql("customer", "c_custkey"))
def f14(spark, d):
    return _UNSPACED.over(table(spark, d, "customer"), "c_custkey").select("c_custkey", F.array_join(T.sentences_without_space(F.col("text")), "|").alias("sentences"))


_SHOWN = Samples("shown string, source string, other string", ("verbatim", "missing"), [
    ("<p>Ein <b>Text</b></p>", "Ein Text", "Ein Text", True, 0), ("<p>Ein Text</p>", "Ein, Text!", "text", True, 1), ("<p>Text Ein</p>", "Ein Text", "", False, 2), ("Ein Tex", "Ein Text", "ein ein text", False, 0), ("", "", "x", True, 0), ("a a b", "a a b", "a b b", True, 1), ("<br>1<br>2", "12", "12", True, 0),
])


@query("f21_verbatim_proof", _SHOWN.sql("customer", "c_custkey"))
def f21(spark, d):
    rows = _SHOWN.over(table(spark, d, "customer"), "c_custkey")
    return rows.select("c_custkey", T.is_verbatim(F.col("shown"), F.col("source")).alias("verbatim"), T.word_multiset_missing(F.col("source"), F.col("other")).cast("long").alias("missing"))


@query("f27_forbidden_characters", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 0 END::BIGINT AS n_forbidden FROM customer")
def f27(spark, d):
    texts = ["a\u0001b", "\u0000\u0008\u001f", "tab\t line\n cr\r", "\ufffe\uffff", "plain \U0001f600 \ud7ff\ue000"]
    text = F.get(F.array(*map(F.lit, texts)), F.pmod("c_custkey", F.lit(5)).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.size(T.forbidden_in_xml(text)).cast("long").alias("n_forbidden"))


@query("t4_dates_of_lines", """SELECT o_orderkey, line, strftime(o_orderdate + to_days(line * 40), '%Y-%m-%d') AS day, CASE line WHEN 0 THEN 3 WHEN 1 THEN 0 ELSE 7 END + o_orderkey % 5 AS start, CASE line WHEN 0 THEN 'numeric' WHEN 1 THEN 'iso' ELSE 'month_name' END AS form FROM orders, range(3) r(line)""")
def t4(spark, d):
    """Dates of all lines with their places: three lines for each order, with a date in each of the forms."""
    o = dealt(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.repeat(F.lit(" "), F.pmod("o_orderkey", F.lit(5)).cast("int")).alias("pad"))
    months = F.array(*[F.lit(m.split()[0]) for m in D.MONTHS])
    later = lambda n: F.date_add("day", n)
    named = F.concat(F.lit("Bern am"), "pad", F.date_format(later(80), "d"), F.lit(". "), F.get(months, F.month(later(80)) - 1), F.lit(" "), F.date_format(later(80), "yyyy"))
    texts = F.array(F.concat(F.lit("vom"), "pad", F.date_format("day", "d.M.yyyy"), F.lit(" an")), F.concat("pad", F.date_format(later(40), "yyyy-MM-dd")), named)
    rows = o.select("o_orderkey", F.posexplode(texts).alias("line", "text"))
    return rows.select("o_orderkey", "line", F.explode(D.find_dates(F.col("text"))).alias("h")).select("o_orderkey", "line", "h.day", "h.start", "h.form")


# ---- documents


_FIXED = Samples("text string, label string, repeated boolean", ("role", "answer"), [
    ("Seite 3", "text", False, "R1", "furniture"), ("12 / 14", "text", False, "R1", "furniture"), ("p. 4", "text", False, "R1", "furniture"), ("7", "text", True, "R1", "furniture"), ("Art der Sache", "footnote", False, "R2", "text"), ("3) vgl. oben", "text", False, "R2", "text"),
    ("", "picture", False, "R3", "none"), ("Kanton Bern", "text", True, "R4", "furniture"), ("C:\\daten\\brief.doc", "text", False, "R5", "furniture"), ("bericht.pdf", "text", False, "R5", "furniture"), ("Ein Satz.", "text", False, None, "text"), ("2020 war gut", "text", False, None, "text"),
])


def _answer_of(role):
    return F.when(role.isin("R1", "R4", "R5"), "furniture").when(role == "R3", "none").otherwise("text")


@query("d5_fixed_roles", _FIXED.sql("customer", "c_custkey"))
def d5(spark, d):
    """With e3: the roles and the answers that they stand for."""
    rows = _FIXED.over(table(spark, d, "customer"), "c_custkey").withColumn("role", O.fixed_role(F.col("text"), F.col("label"), F.col("repeated")))
    return rows.select("c_custkey", "role", _answer_of(F.col("role")).alias("answer"))


@query("e3_fixed_answers", "SELECT CASE k WHEN 6 THEN 'none' WHEN 4 THEN 'text' WHEN 5 THEN 'text' WHEN 10 THEN 'text' WHEN 11 THEN 'text' ELSE 'furniture' END AS answer, count(*) AS n FROM (SELECT c_custkey % 12 AS k FROM customer) GROUP BY 1")
def e3(spark, d):
    rows = _FIXED.over(table(spark, d, "customer"), "c_custkey")
    return rows.groupBy(_answer_of(O.fixed_role(F.col("text"), F.col("label"), F.col("repeated"))).alias("answer")).agg(F.count("*").alias("n"))


_ROLES = Samples("lines string", ("role", "reason"), [
    ("Beilage 1\nMotion", "other", "O2"), ("Protokoll der Sitzung\nAntwort", "minutes", "M1"), ("Anfrage\nwird beauftragt\n\nAntwort\nJa", "combined", "A1"), ("x\nAntwort\nJa", "combined", "A1"), ("Antwort\n1\n2\n3\n4\n5", "response", "A2"), ("Text\neingereicht von A. Meier", "proposal", "P1"),
    ("Postulat\nText", "proposal", "P2"), ("Brief\nGruss", "other", "D0"), ("", "other", "D0"), ("Réponse\n1\n2\n3\n4", "response", "A2"), ("Mozione\npresentata da Rossi", "proposal", "P1"),
])


@query("d7_document_roles", _ROLES.sql("customer", "c_custkey"))
def d7(spark, d):
    rows = _ROLES.over(table(spark, d, "customer"), "c_custkey")
    lines = rows.select("c_custkey", F.posexplode(F.split("lines", "\n", -1)).alias("line", "text"))
    return O.document_role(O.role_features(lines, "c_custkey")).select("c_custkey", "role", "reason")


_TYPED = Samples("pos int, family string, text string, heading boolean", ("type", "rule"), [
    (0, "TITLE", "Motion betreffend Velowege", True, "title", "default"), (1, "TITLE", "Kurztitel: Velowege", False, "short_title", "label"),
    (2, "SPONSOR", "Antrag", True, "submitted", "submitted_label"), (3, "SPONSOR", "Der Regierungsrat wird beauftragt, Velowege zu bauen.", False, "submitted", "request"), (4, "SPONSOR", "Ausgangslage", True, "reasoning", "heading_before"), (5, "SPONSOR", "Begründung", True, "reasoning", "label"),
    (6, "SPONSOR", "Es hat zu wenige Wege, und das seit vielen Jahren schon.", False, "reasoning", "continues"), (7, "SPONSOR", "Wir bitten um die Beantwortung, wir fordern zudem folgende Dinge.", False, "submitted", "request"), (8, "SPONSOR", "Mehr davon.", False, "submitted", "default"),
    (9, "EXECUTIVE", "Antwort des Regierungsrates", True, "response", "heading"), (10, "EXECUTIVE", "Die Wege sind gut. Es hat genug davon. Das zeigt die Statistik.", False, "response", "default"), (11, "EXECUTIVE", "Der Regierungsrat beantragt die Ablehnung.", False, "recommendation", "proposal"),
    (12, "EXECUTIVE", "Weitere Gedanken folgen hier.", False, "response", "default"), (13, "EXECUTIVE", "Antrag:", True, "recommendation", "label"), (14, "EXECUTIVE", "Die Motion sei abzulehnen.", False, "recommendation", "continues"), (15, "EXECUTIVE", "Kosten", True, "response", "heading"),
    (16, "EXECUTIVE", "Fazit", True, "recommendation", "weak_label"), (17, "EXECUTIVE", "Le Conseil communal vous propose de refuser la motion.", False, "recommendation", "continues"), (18, "EXECUTIVE", "Fazit", True, "response", "weak_label_alone"), (19, "EXECUTIVE", "Ende.", False, "response", "default"),
    (20, "EXECUTIVE", "Antrag: Ablehnung der Motion", False, "recommendation", "inline_label"), (21, "EXECUTIVE", "Danke.", False, "response", "default"), (22, "EXECUTIVE", "Der Stadtrat beantragt aus nachstehenden Gründen die Ablehnung.", False, "response", "default"),
    (23, "PLENARY", "Beratung", True, "speech", "heading_before"), (24, "PLENARY", "Meier Anna, SP: Ich bin dafür.", False, "speech", "speaker"), (25, "PLENARY", "Und zwar sehr.", False, "speech", "continues"), (26, "PLENARY", "Der Rat beschliesst mit 40 zu 20 Stimmen Annahme.", False, "vote", "resolution"),
    (27, "OTHER", "Beilage", False, None, None), (28, "SPONSOR", "3. Gründe", True, "reasoning", "label"), (29, "SPONSOR", "Sie sind zahlreich.", False, "reasoning", "continues"), (30, "SPONSOR", "4. Schluss", True, "submitted", "same_depth"), (31, "SPONSOR", "So weit.", False, "submitted", "default"),
])


@query("d9_types_in_family", _TYPED.of_each_sql("supplier", "s_suppkey"))
def d9(spark, d):
    rows = _TYPED.of_each(table(spark, d, "supplier"), "s_suppkey")
    return A.types_in_family(rows, "s_suppkey", "pos", "family", "text", "heading").select("s_suppkey", "k", "type", "rule")


_CHAIN = Samples("doc int, pos int, role string, text string, label string", ("answer",), [
    (0, 0, "proposal", "Velowege im Kanton", "title", "title/title"), (0, 1, "proposal", "Motion", "section_header", "sponsor/submitted"), (0, 2, "proposal", "Der Rat wird beauftragt, Wege zu bauen.", "text", "sponsor/submitted"), (0, 3, "proposal", "Begründung", "section_header", "sponsor/reasoning"),
    (0, 4, "proposal", "Antwort wird erwartet.", "text", "sponsor/reasoning"), (0, 5, "proposal", "Seite 1", "text", "furniture"), (0, 6, "proposal", "", "picture", "none"),
    (1, 0, "response", "Velowege im Kanton", "title", "title/title"), (1, 1, "response", "Antwort", "section_header", "executive/response"), (1, 2, "response", "Motion Meier ist bekannt.", "text", "executive/response"), (1, 3, "response", "Der Regierungsrat beantragt die Annahme.", "text", "executive/recommendation"), (1, 4, "response", "3) vgl. oben", "text", "footnote"),
    (2, 0, "combined", "Motion", "section_header", "sponsor/submitted"), (2, 1, "combined", "Antwort", "section_header", "executive/response"), (3, 0, "minutes", "Beratung", "section_header", "plenary/speech"), (3, 1, "minutes", "MEIER A. - Ich bin dafür.", "text", "plenary/speech"),
    (4, 0, "other", "Motion", "section_header", "text"), (4, 1, "other", "12", "text", "furniture"),
])


@query("d11_rule_chain", _CHAIN.of_each_sql("supplier", "s_suppkey"))
def d11(spark, d):
    rows = _CHAIN.of_each(table(spark, d, "supplier"), "s_suppkey").withColumn("id", F.concat_ws("-", "s_suppkey", "doc"))
    answers = A.rule_chain(rows.select("id", "pos", "role", "text", "label", "s_suppkey", "k"), "id", "pos", "text", "label", "role")
    return answers.join(rows.select("id", "pos", "s_suppkey", "k"), ["id", "pos"]).select("s_suppkey", "k", "answer")


_SWITCHED = Samples("doc int, line int, text string", ("previous", "family"), [
    (0, 0, "Motion", None, None), (0, 1, "Text", None, None), (0, 2, "Antwort des Rates", "SPONSOR", "EXECUTIVE"), (0, 3, "Text", None, None), (0, 4, "Beratung", "EXECUTIVE", "PLENARY"), (0, 5, "Stellungnahme", "PLENARY", "EXECUTIVE"), (1, 0, "Text", None, None), (1, 1, "Postulat", None, None), (1, 2, "Interpellation", None, None),
])


@query("d8_author_switch_rule", f"SELECT s_suppkey, k, previous, family FROM ({_SWITCHED.of_each_sql('supplier', 's_suppkey')}) WHERE family IS NOT NULL")
def d8(spark, d):
    from gatherum.operators import sequence as Q

    family = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in A._FAMILY_MARKS:
        family = family.when(F.col("text").rlike(pattern), name)
    rows = _SWITCHED.of_each(table(spark, d, "supplier"), "s_suppkey").withColumns({"id": F.concat_ws("-", "s_suppkey", "doc"), "family": family})
    return Q.switches(rows, "id", "line", "family").join(rows.select("id", "line", "s_suppkey", "k"), ["id", "line"]).select("s_suppkey", "k", "previous", "family")


_LETTERS = Samples("lines string", ("executive", "letter", "decision", "proposal"), [
    ("Der Regierungsrat antwortet wie folgt", True, False, False, False), ("Sehr geehrte Frau Meier\nText", False, True, False, False), ("x\n" * 26 + "Sehr geehrte Frau", False, False, False, False), ("Das Parlament hat beschlossen", False, False, True, False), ("eingereicht von A. Meier", False, False, False, True),
    ("Le Grand Conseil décrète\nMonsieur", False, True, True, False), ("Text", False, False, False, False), ("", False, False, False, False), ("Risposta del Consiglio\nfirmatari", True, False, False, True),
])


@query("d24_form_predicates", _LETTERS.sql("customer", "c_custkey"))
def d24(spark, d):
    rows = _LETTERS.over(table(spark, d, "customer"), "c_custkey")
    return A.form_predicates(rows.select("c_custkey", F.posexplode(F.split("lines", "\n", -1)).alias("line", "text")), "c_custkey", "line", "text")


_CELLS = Samples("page int, pos int, text string, x double, top double, bottom double", ("line", "joined"), [
    (0, 0, "1.", 10.0, 10.0, 20.0, 0, "1. Antrag"), (0, 1, " Antrag ", 30.0, 11.0, 21.0, None, None), (0, 2, "  ", 50.0, 11.0, 21.0, None, None), (0, 3, "Text", 10.0, 25.0, 35.0, 1, "Text"), (0, 4, "links", 5.0, 25.0, 35.0, 2, "links"), (0, 5, "halb", 60.0, 31.0, 41.0, 3, "halb hoch"), (0, 6, "hoch", 80.0, 28.0, 35.0, None, None),
    (1, 0, "neu", 10.0, 25.0, 35.0, 0, "neu"), (1, 1, "flach", 20.0, 30.0, 30.0, 1, "flach"),
])


@query("d1_cells_to_lines", f"SELECT s_suppkey, line, joined AS text, k::INTEGER AS first FROM ({_CELLS.of_each_sql('supplier', 's_suppkey')}) WHERE line IS NOT NULL")
def d1(spark, d):
    rows = _CELLS.of_each(table(spark, d, "supplier"), "s_suppkey").withColumn("id", F.concat_ws("-", "s_suppkey", "page"))
    lines = A.cells_to_lines(rows.withColumn("k", F.col("k")), "id", "k", "text", "x", "top", "bottom")
    return lines.join(rows.select("id", "s_suppkey").distinct(), "id").select("s_suppkey", "line", "text", "first")


_PLACES = Samples("class string, lines string", ("pass", "line", "start", "word"), [
    ("motion", "Titel\n  Motion Meier\nMotion", 1, 1, 2, "Motion"), ("question", "Conseil - Question écrite\nText", 2, 0, 10, "Question"), ("question", "Ein langer Satz mit vielen Wörtern über eine Question darin", None, None, None, None), ("decree", "Kredit für die Brücke", 3, 0, 0, "Kredit"),
    ("motion", "Kredit", None, None, None, None), ("decree", "Der Kredit\nBeschluss des Rates", 1, 1, 0, "Beschluss"),
])


@query("d29_class_places", f"SELECT c_custkey, pass, line, start, word FROM ({_PLACES.sql('customer', 'c_custkey')}) WHERE pass IS NOT NULL")
def d29(spark, d):
    rows = _PLACES.over(table(spark, d, "customer"), "c_custkey")
    lines = rows.select("c_custkey", F.posexplode(F.split("lines", "\n", -1)).alias("line", "text"))
    places = A.class_places(lines, "c_custkey", "line", "text", rows.select("c_custkey", "class"), {"motion": "motion|mozione", "decree": "beschluss|dekret"}, {"question": "question|anfrage"}, {"decree": "kredit|verordnung"})
    return places.select("c_custkey", "pass", "line", "start", "word")


_ANCHORS = Samples("line int, text string", ("share", "anchored"), [
    (0, "Velowege und Strassen im Kanton Bern bauen", 1.0, True), (1, "Velowege Strassen bauen", 1.0, True), (2, "Velowege im Dorf bauen heute", 0.5, False), (3, "Kanton Bern", 1.0, True), (4, "", 0.0, False), (5, "Kanton Bern bauen Strassen", 1.0, True), (6, "Kanton Zug", 0.5, False),
])


@query("e4_title_anchor", f"SELECT s_suppkey, k, share, anchored FROM ({_ANCHORS.of_each_sql('supplier', 's_suppkey')})")
def e4(spark, d):
    """Lines that share three quarters of their content words with the title, the first line: those of runs that cover half of its words."""
    rows = _ANCHORS.of_each(table(spark, d, "supplier"), "s_suppkey")
    title = rows.where("line = 0").select("s_suppkey", F.col("text").alias("title"))
    shared = rows.join(title, "s_suppkey").withColumn("share", T.share_of_words(F.col("text"), F.col("title")))
    return shared.select("s_suppkey", "k", "share", (F.col("share") >= 0.75).alias("anchored"))


# ---- gaps and segments


@query("j15_nearest_gaps", """SELECT c_custkey, ref, got, "offset" FROM customer, (VALUES (0, 5, 5, 0), (0, 10, 11, 1), (0, 20, 18, -2), (0, NULL, 40, NULL), (1, 3, 2, -1), (1, 4, 5, 1), (1, 9, NULL, NULL), (2, 7, NULL, NULL)) v(m, ref, got, "offset") WHERE c_custkey % 3 = m""")
def j15(spark, d):
    c = table(spark, d, "customer")
    k = F.pmod("c_custkey", F.lit(3)).cast("int")
    gaps = lambda *lists: c.select("c_custkey", F.explode(F.get(F.array(*[F.array(*map(F.lit, x)).cast("array<int>") for x in lists]), k)).alias("at"))
    return A.nearest_gaps(gaps([5, 10, 20], [3, 4, 9], [7]), gaps([5, 11, 18, 40], [2, 5], []), "c_custkey", "at")


@query("e1_segmentation_errors", """SELECT c_custkey, segment, error FROM customer, (VALUES (1, 0, 'unknown_class'), (2, 1, 'wrong_start'), (3, 1, 'outside'), (4, 1, 'lines_left'), (5, 1, 'same_class'), (6, 0, 'backwards'), (6, 0, 'wrong_start'), (6, 1, 'wrong_start')) v(m, segment, error) WHERE c_custkey % 7 = m""")
def e1(spark, d):
    """Ten main lines in each document; every seventh segmentation is valid, each of the others has faults of its own."""
    whole = [[("a", 0, 4), ("b", 5, 9)], [("x", 0, 4), ("b", 5, 9)], [("a", 0, 4), ("b", 6, 9)], [("a", 0, 4), ("b", 5, 10)], [("a", 0, 4), ("b", 5, 8)], [("a", 0, 4), ("a", 5, 9)], [("a", 4, 2), ("b", 4, 9)]]
    rows = [(m, k, c, a, b) for m, segments in enumerate(whole) for k, (c, a, b) in enumerate(segments)]
    cases = spark.createDataFrame(rows, "m int, segment int, class string, first int, last int")
    docs = table(spark, d, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(7)).cast("int").alias("m"))
    return A.segmentation_errors(docs.join(F.broadcast(cases), "m").drop("m"), docs.withColumn("n", F.lit(10)), "c_custkey", ["a", "b"])


_SEGMENTED = "(SELECT user_id, pos, CASE WHEN pos % 7 <> 3 THEN pos // 4 END AS ref, CASE WHEN pos % 11 <> 5 THEN (pos + user_id % 3) // 5 END AS hyp FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events))"


@query("e1_segmentation_summary", f"""WITH s AS (SELECT *, last_value(hyp IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM {_SEGMENTED} WHERE ref IS NOT NULL),
  b AS (SELECT *, row_number() OVER w > 1 AND ref IS DISTINCT FROM lag(ref) OVER w AS br, row_number() OVER w > 1 AND h IS DISTINCT FROM lag(h) OVER w AS bh FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
  d AS (SELECT user_id, count(*) FILTER (br AND bh) AS tp, count(*) FILTER (br) AS n_ref, count(*) FILTER (bh) AS n_hyp, count(*) AS content, count(*) FILTER (hyp IS NULL) AS omitted FROM b GROUP BY user_id),
  t AS (SELECT count(*) AS documents, sum(tp) / sum(n_hyp)::DOUBLE AS precision, sum(tp) / sum(n_ref)::DOUBLE AS recall, sum(omitted) / sum(content)::DOUBLE AS omission_rate, count(*) FILTER (tp = n_ref AND tp = n_hyp AND omitted = 0) / count(*)::DOUBLE AS exact_rate FROM d)
  SELECT documents, round(precision, 9) AS precision, round(recall, 9) AS recall, round(precision * recall * 2 / (precision + recall), 9) AS f1, round(omission_rate, 9) AS omission_rate, round(exact_rate, 9) AS exact_rate FROM t""")
def e1_summary(spark, d):
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, d, "events").withColumn("pos", pos)
    rows = rows.select("user_id", "pos", F.when(F.col("pos") % 7 != 3, F.floor(F.col("pos") / 4)).alias("ref"), F.when(F.col("pos") % 11 != 5, F.floor((F.col("pos") + F.col("user_id") % 3) / 5)).alias("hyp"))
    summary = A.segmentation_summary(A.compare_segmentations(rows, "user_id", "pos", "ref", "hyp"))
    return summary.select("documents", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "omission_rate", "exact_rate")])


# ---- splits


@query("e11_split_membership", "SELECT doc_id, CASE WHEN source IS NULL THEN 'unknown' WHEN source IN ('src1', 'src5') THEN 'held_out' END AS reason FROM (SELECT r.id AS doc_id, source FROM (SELECT doc_id AS id FROM labels UNION ALL SELECT doc_id + 1000000 FROM labels WHERE doc_id % 10 = 0) r LEFT JOIN documents d ON r.id = d.doc_id) WHERE source IS NULL OR source IN ('src1', 'src5')")
def e11(spark, d):
    """Ids that must not be used: of held-out sources, or of no known document."""
    lab = table(spark, d, "labels").select("doc_id")
    asked = lab.unionByName(lab.where("doc_id % 10 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id")))
    held = spark.createDataFrame([("src1",), ("src5",)], "source string").withColumn("held", F.lit(True))
    found = asked.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id", "left").join(F.broadcast(held), "source", "left")  # a fixed list of sources
    return found.select("doc_id", F.when(F.col("source").isNull(), "unknown").when(F.col("held"), "held_out").alias("reason")).where("reason is not null")


@query("e8_one_of_each_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('11:' || doc_id), doc_id) AS r, sha256('11:' || source) AS turn FROM documents WHERE n_chars BETWEEN 200 AND 20000 AND doc_id NOT IN (SELECT doc_id FROM labels)) WHERE r = 1 ORDER BY turn LIMIT 7")
def e8(spark, d):
    """One document of each group that isn't taken yet, by a hash with a seed, and seven of the groups, by a hash too."""
    h = lambda c: F.sha2(F.concat(F.lit("11:"), F.col(c).cast("string")).cast("binary"), 256)
    free = table(spark, d, "documents").where("n_chars BETWEEN 200 AND 20000").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    one = free.groupBy("source").agg(F.min_by("doc_id", F.struct(h("doc_id"), "doc_id")).alias("doc_id"))
    return one.orderBy(h("source")).limit(7)


@query("e14_decision_record", "SELECT d.doc_id, CASE WHEN d.source = 'src3' THEN 'refused' WHEN l.quality = 1 THEN 'rule' WHEN l.toxic = 1 THEN 'model' ELSE 'none' END AS decided_by, CASE WHEN d.source <> 'src3' THEN CASE WHEN l.quality = 1 THEN d.lang WHEN l.toxic = 1 THEN 'xx' END END AS value FROM documents d LEFT JOIN labels l USING (doc_id)")
def e14(spark, d):
    """One decision record for each document: the certain rule's value, else the model's; documents of a held-out source are refused."""
    from gatherum.operators import measure as M

    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    held = F.col("source") == "src3"
    return docs.select("doc_id", *M.decision(F.when(F.col("quality") == 1, F.col("lang")), F.when(F.col("toxic") == 1, F.lit("xx")), held))
