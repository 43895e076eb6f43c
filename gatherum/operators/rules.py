"""Ordered rule tables: the first matching rule decides. Rules are data; they compile to one CASE expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    value: str
    pattern: str


def classify(text: Column, rules: list[Rule], empty: str, other: str) -> Column:
    """Value of the first rule whose pattern is in the text, in any case."""
    out = F.when(F.coalesce(F.trim(text), F.lit("")) == "", empty)
    for r in rules:
        out = out.when(text.rlike("(?iu)" + r.pattern), r.value)
    return out.otherwise(other)


def classify_distinct(df: DataFrame, column: str, rules: list[Rule], out: str, empty: str, other: str) -> DataFrame:
    """``classify`` once for each distinct value, joined back: for columns with few values and long rule lists."""
    key = F.col(column).alias("_value")
    labels = df.select(key).distinct().withColumn(out, classify(F.col("_value"), rules, empty, other))
    return df.join(labels, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


def as_sql(expression: str, rules: list[Rule], empty: str, other: str) -> str:
    """The same decision as a SQL expression (patterns without look-around)."""
    whens = " ".join(f"WHEN regexp_matches({expression}, '(?i){r.pattern}') THEN '{r.value}'" for r in rules)
    return f"CASE WHEN coalesce(trim({expression}), '') = '' THEN '{empty}' {whens} ELSE '{other}' END"


def first_candidate(candidates: DataFrame, keys: list[str], tier_rank: str = "tier_rank", order: tuple[str, ...] = ("start",), others: int | None = None) -> DataFrame:
    """For each key the candidate of the best tier (ties by ``order``), with the number of others left behind."""
    w = Window.partitionBy(*keys).orderBy(tier_rank, *order)
    whole = Window.partitionBy(*keys)
    return candidates.withColumns({"_place": F.row_number().over(w), "n_others": F.count("*").over(whole) - 1}).where("_place = 1").drop("_place")


# Classes of document names, by words of three languages.
NAME_CLASSES = [
    Rule("antwort", r"antwort|beantwortung|stellungnahme|\brrb\b|regierungsratsbeschluss|r[ée]ponse|risposta|prise de position|rapport du conseil d.[ée]tat|r[ée]ponse du conseil|rapporto del consiglio di stato|presa di posizione"),
    Rule("vorstoss", r"motion|postulat|interpellation|anfrage|\bfrage\b|fragestunde|vorstoss|parlamentarische initiative|einzelinitiative|beh[öo]rdeninitiative|standesinitiative|question|interpellanza|mozione|interrogazione|iniziativa parlamentare|initiative parlementaire|r[ée]solution|resolution|petition|p[ée]tition|dringliche|urgente|eingereicht|d[ée]pos[ée]|wortlaut"),
    Rule("bericht_vorlage", r"bericht|botschaft|vorlage|antrag|message|rapport|messaggio|preavviso|entwurf|projet|disegno|erl[äa]uter"),
    Rule("beschluss", r"beschluss|d[ée]cision|decisione|risoluzione|d[ée]cret|dekret"),
    Rule("protokoll", r"protokoll|proc[èe]s-verbal|verbale|bulletin|wortprotokoll"),
    Rule("beilage", r"beilage|anhang|annexe|allegato|anlage"),
]


def level_of(key: Column) -> Column:
    """Level of government of a body's key."""
    return F.when(key == "CHE", "bund").when(key == "LIE", "ausland_li").when(key.rlike("^[0-9]+$"), "gemeinde").otherwise("kanton")


# Groups of formats, by the whole MIME type or by words in it.
FORMATS = {
    "pdf": ("application/pdf", "pdf"), "bild": ("jpg", "jpeg", "png", "webp", "gif", "tif", "tiff"), "audio_video": ("vimeo",), "link": ("link",),
}
FORMAT_WORDS = [("html", "html"), ("^image", "bild"), ("^video", "audio_video"), ("^audio", "audio_video"), ("word", "office"), ("spreadsheet", "office"), ("excel", "office"), ("rtf", "office"), ("presentation", "office"), ("opendocument", "office"), ("zip", "zip")]
# Types that say nothing; there the extension may.
FORMAT_UNKNOWN = {"": "unbekannt", "application/octet-stream": "andere"}


def format_group(mime: Column, extension: Column) -> Column:
    """Nine groups of formats from a MIME type and the extension of the URL: a look-up of the type, then of words in it."""
    kind = F.lower(F.coalesce(mime, F.lit("")))
    pairs = [(name, group) for group, names in FORMATS.items() for name in names]
    by_name = F.get(F.array(F.create_map(*[F.lit(x) for pair in pairs for x in pair])), F.lit(0))[kind]
    words = F.transform(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(g).alias("group")) for w, g in FORMAT_WORDS]), lambda x: F.when(F.rlike(kind, x["word"]), x["group"]))
    silent = F.get(F.array(F.create_map(*[F.lit(x) for pair in FORMAT_UNKNOWN.items() for x in pair])), F.lit(0))[kind]
    by_extension = F.when(silent.isNotNull(), F.when(extension == "pdf", "pdf_laut_url").otherwise(silent))
    return F.coalesce(by_extension, by_name, F.get(F.array_compact(words), F.lit(0)), F.lit("andere"))


def url_extension(url: Column) -> Column:
    """Lower-case extension of the path's last part, of at most five letters or digits; else empty."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z]+://[^/]*", "")
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))


def masked_category(c: Column, mask: str = "(freitext)") -> Column:
    """A category that is a file name or longer than 80 characters is masked."""
    return F.when(c.rlike(r"(?i)\.(pdf|docx?|xlsx?|html?|zip)$") | (F.length(c) > 80), mask).otherwise(c)
