"""Documents: zones, fixed roles of lines, roles of documents, sentence and coverage checks, levels of isolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherum.functions import text as T
from gatherum.operators.rules import Rule


def zone(top: Column, height: Column) -> Column:
    """head (upper fifth), foot (lower eighth) or body of a page."""
    return F.when(top < height * 0.2, "head").when(top > height * 0.88, "foot").otherwise("body")


def fixed_role(text: Column, label: Column, repeated: Column) -> Column:
    """Roles that need no reading: R1 page number, R2 footnote, R3 picture, R4 repeated header or footer, R5 file data."""
    return (
        F.when(text.rlike(r"(?i)^\s*(?:seite|page|pagina|p\.|s\.)?\s*\d{1,4}(?:\s*(?:/|von|de|di|of)\s*\d{1,4})?\s*$"), "R1")
        .when((label == "footnote") | text.rlike(r"^\s*\d{1,2}\)?\s+(?i:vgl|siehe|cf|voir|cfr)\b"), "R2")
        .when(label == "picture", "R3")
        .when(repeated, "R4")
        .when(text.rlike(r"(?i)\.(?:docx?|pdf|xlsx?)\s*$|^[a-z]:\\|^/[\w./-]+$"), "R5")
    )


def levels(answers: DataFrame, answer: str, maps: dict[str, dict[str, str]]) -> DataFrame:
    """Coarser answers: one column per level, each a map from the answer; what a map lacks stays."""
    out = answers
    for level, m in maps.items():
        lookup = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
        out = out.withColumn(level, F.coalesce(lookup[F.col(answer)], F.col(answer)))
    return out


#: Decision list of a document's role: (role, reason, condition over the features of ``role_features``).
ROLE_RULES: list[tuple[str, str, str]] = [
    ("other", "O2", "attachment_head"),
    ("minutes", "M1", "protocol_head"),
    ("combined", "A1", "answer_at is not null and (demand_marks >= 1 or answer_at * 4 >= n_lines)"),
    ("response", "A2", "answer_at is not null"),
    ("proposal", "P1", "sponsor_marks >= 1"),
    ("proposal", "P2", "proposal_words >= 1"),
]
# Words of headings in three languages.
ANSWER = r"(?iu)^\s*(?:antwort|beantwortung|stellungnahme|r[ée]ponse|risposta|presa di posizione)\b"
ATTACHMENT = r"(?iu)^\s*(?:beilage|anhang|annexe|allegato)\b"
PROTOCOL = r"(?iu)protokoll|proc[èe]s-verbal|verbale"
DEMAND = r"(?iu)wird beauftragt|ist beauftragt|est charg[ée]|[èe] incaricato|begr[üu]ndung|d[ée]veloppement|motivazione"
SPONSOR = r"(?iu)eingereicht von|unterzeichnende|d[ée]pos[ée]e? par|soussign|presentat[oa] da|firmatari"
PROPOSAL = r"(?iu)motion|postulat|interpellation|anfrage|mozione|interpellanza|interrogazione"


# Words without one of which a pattern of those above matches nothing, in small letters.
_HINTS = {
    PROTOCOL: ("protokoll", "verbal"),
    DEMAND: ("beauftragt", "charg", "incaricato", "begründung", "begrundung", "veloppement", "motivazione"),
    SPONSOR: ("eingereicht von", "unterzeichnende", "dépos", "depos", "soussign", "presentat", "firmatari"),
    PROPOSAL: ("motion", "postulat", "interpella", "anfrage", "mozione", "interrogazione"),
}


def role_features(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row of features per document from its lines (line, text): aggregates only."""
    head, text = F.col("line") < 15, F.col("text")
    says = lambda pattern: T.holds_any(F.col("_folded"), _HINTS[pattern]) & text.rlike(pattern)
    return lines.withColumn("_folded", T.folded(text)).groupBy(doc).agg(
        F.count("*").alias("n_lines"),
        F.min(F.when(text.rlike(ANSWER), F.col("line"))).alias("answer_at"),
        F.coalesce(F.bool_or(head & text.rlike(ATTACHMENT)), F.lit(False)).alias("attachment_head"),
        F.coalesce(F.bool_or(head & says(PROTOCOL)), F.lit(False)).alias("protocol_head"),
        F.count_if(says(DEMAND)).alias("demand_marks"),
        F.count_if(says(SPONSOR)).alias("sponsor_marks"),
        F.count_if(says(PROPOSAL)).alias("proposal_words"),
    )


def document_role(features: DataFrame, rules: list[tuple[str, str, str]] = ROLE_RULES) -> DataFrame:
    """Adds role and reason: the first rule that holds, else other, D0."""
    role = reason = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, why, condition in rules:
        role, reason = role.when(F.expr(condition), name), reason.when(F.expr(condition), why)
    return features.withColumns({"role": role.otherwise("other"), "reason": reason.otherwise("D0")})


def last_hit(text: Column, rules: list[Rule]) -> Column:
    """The value whose pattern's last match in the text is the latest; null without a match. Ties go to the earlier rule."""
    places = [F.struct(_last_place(text, r.pattern).alias("at"), F.lit(-k).alias("order"), F.lit(r.value).alias("value")) for k, r in enumerate(rules)]
    best = F.array_max(F.filter(F.array(*places), lambda x: x["at"] > 0))
    return best["value"]


def _last_place(text: Column, pattern: str) -> Column:
    """Place behind the last match, from 1; 0 without one."""
    pieces = F.split(text, pattern, -1)
    return F.when(F.size(pieces) > 1, F.length(text) - F.length(F.element_at(pieces, -1)) + 1).otherwise(F.lit(0))


def rendered(blocks: DataFrame, doc: str, page: str, pos: str, text: str) -> DataFrame:
    """(doc, text): blocks in order with a mark at each new page."""
    w = Window.partitionBy(doc).orderBy(pos)
    marked = blocks.withColumn("_t", F.when(F.lag(page).over(w).eqNullSafe(F.col(page)), F.col(text)).otherwise(F.concat(F.lit("[page "), F.col(page).cast("string"), F.lit("]\n"), F.col(text))))
    return marked.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos), F.col("_t")))), lambda x: x["_t"]), "\n\n").alias("text"))


def head_and_tail_pages(blocks: DataFrame, doc: str, page: str, first: int = 3) -> DataFrame:
    """Blocks of the first pages and of the last page of each document."""
    span = blocks.groupBy(doc).agg(F.max(page).alias("_last"), F.array_sort(F.collect_set(page)).alias("_pages"))
    return blocks.join(span, doc).where(F.array_contains(F.slice("_pages", 1, first), F.col(page)) | (F.col(page) == F.col("_last"))).drop("_last", "_pages")


def long_sentences(df: DataFrame, doc: str, text: str, words: int = 40) -> DataFrame:
    """(doc, sentence): sentences of more words than that."""
    cut = df.select(doc, F.explode(T.sentences(F.col(text))).alias("sentence"))
    return cut.where(F.size(F.split(F.trim("sentence"), r"\s+")) > words)
