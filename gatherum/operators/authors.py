"""Authors of an affair: the names, groups and marks in a line, by a small automaton over classes of tokens.

A line becomes tokens, each of one class (a known first name, another capitalised word, a particle, a party, a bracket ...). One
``aggregate`` walks over them: the state and the class give the next state and what is done with the token, from a table. What
comes out are the names in order, each with first names, family name, party and place, the groups, and how many others signed.
First names are known from a dictionary, which is a table; it goes to the executors whole if it is small, else its words are joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherum.functions import text as T
from gatherum.operators.sequence import starts_of

# Words around names, in German, French and Italian.
TITLES = ("herr", "herrn", "frau", "dr", "prof", "lic", "iur", "monsieur", "madame", "mme", "m", "signor", "signora", "on", "sprecher", "sprecherin", "porte-parole", "portavoce", "urheber", "urheberin", "auteur", "autrice", "autore", "motionar", "postulant", "interpellant", "nationalrat", "nationalratin", "kantonsrat", "kantonsratin", "gemeinderat", "gemeinderatin", "landrat", "landratin", "depute", "deputee", "deputato", "deputata", "erstunterzeichner", "erstunterzeichnerin")
LEADS = ("von", "par", "di", "durch", "de", "da", "eingereicht", "depose", "deposee", "presentata", "presentato")
PARTICLES = ("von", "vom", "van", "de", "di", "da", "del", "della", "der", "den", "la", "le", "du", "zu", "zur", "d", "al")
ANDS = ("und", "et", "e", "ed", "sowie", "&")
PARTIES = ("SP", "FDP", "SVP", "CVP", "EVP", "GLP", "GPS", "EDU", "BDP", "GB", "JGB", "AL", "PdA", "PS", "PLR", "UDC", "PDC", "PEV", "PVL", "PBD", "POP", "PPD", "UDF", "MCG", "LEGA", "GRÜNE", "Grüne", "Verts", "Verdi", "Mitte", "Centre", "Centro", "parteilos", "indépendant", "indipendente")
GROUPS = ("fraktion", "groupe", "gruppo", "kommission", "commission", "commissione", "partei", "parti", "partito")
OTHERS = ("mitunterzeichnende", "mitunterzeichnenden", "mitunterzeichner", "mitunterzeichnerinnen", "cosignataires", "cosignataire", "cofirmatari", "unterzeichnende", "mitunterzeichnete")

#: Dictionaries of up to so many words go to the executors whole.
SMALL = 20_000
_TOKENS = r"\s+|\p{L}[\p{L}\p{M}'’\-]*\.?|\d+|[^\s\p{L}\d]"
_CLASSES = ("first", "capital", "initial", "particle", "title", "party", "group", "open", "close", "comma", "and", "colon", "number", "others", "word")


def _table() -> dict[str, tuple[str, str]]:
    """state|class to (next state, action)."""
    ends = {"comma": "after", "open": "brackets", "close": "after", "and": "start", "colon": "start", "number": "start", "word": "start", "title": "start", "others": "start"}
    names = {
        "first": {"first": ("first", "add"), "capital": ("family", "add"), "initial": ("first", "add"), "particle": ("first", "add")},
        "family": {"first": ("first", "next"), "capital": ("family", "add"), "initial": ("family", "add"), "particle": ("family", "add")},
        "plain": {"first": ("reversed", "add"), "capital": ("family", "add"), "initial": ("plain", "add"), "particle": ("plain", "add")},
        "reversed": {"first": ("first", "next"), "capital": ("plain", "next"), "initial": ("reversed", "add"), "particle": ("reversed", "skip")},
    }
    out: dict[tuple[str, str], tuple[str, str]] = {}
    for state, inner in names.items():
        for c in _CLASSES:
            out[state, c] = inner.get(c) or ("after", "close_party") if c == "party" else inner.get(c) or ("group", "close_group") if c == "group" else inner.get(c) or (ends[c], "close")
    begin = {"first": ("first", "open"), "capital": ("plain", "open"), "group": ("group", "group"), "party": ("after_party", "group"), "number": ("start", "number"), "others": ("start", "others"), "open": ("brackets", "skip"), "close": ("after", "skip")}
    for c in _CLASSES:
        out["start", c] = begin.get(c, ("start", "skip"))
        out["after", c] = {"party": ("after", "party"), "capital": ("maybe", "open"), "comma": ("after", "skip")}.get(c, out["start", c])
        out["after_party", c] = {"capital": ("plain", "open"), "group": ("group", "group_add"), "party": ("after_party", "group")}.get(c, out["start", c])
        out["brackets", c] = {"party": ("brackets", "party"), "capital": ("brackets", "place"), "first": ("brackets", "place"), "close": ("after", "skip"), "colon": ("start", "skip")}.get(c, ("brackets", "skip"))
        out["group", c] = {"comma": ("after", "skip"), "first": ("first", "open"), "open": ("brackets", "skip"), "close": ("after", "skip"), "colon": ("start", "skip"), "others": ("start", "others"), "number": ("start", "number")}.get(c, ("group", "group_add"))
        # a capitalised word behind a comma: a place, unless it goes on as a name
        out["maybe", c] = {"first": ("reversed", "add"), "capital": ("family", "add"), "particle": ("plain", "add"), "initial": ("plain", "add"), "party": ("after", "as_place_party"), "group": ("group", "as_place_group")}.get(c, (ends.get(c, "start"), "as_place"))
    return {f"{s}|{c}": v for (s, c), v in out.items()}


def tokens(line: Column) -> Column:
    """Array of (t, at, plain): words, numbers and marks with their places (code points) and, for words, a plain form."""
    raw = F.regexp_extract_all(line, F.lit(_TOKENS), F.lit(0))
    plain = lambda t: F.regexp_replace(T.fold_latin(t), r"\.$", "")
    placed = T.let(raw, lambda r: F.zip_with(r, starts_of(F.transform(r, lambda t: F.length(t).cast("long"))), lambda t, at: F.struct(t.alias("t"), at.alias("at"), plain(t).alias("plain"))))
    return F.filter(placed, lambda x: ~x["t"].rlike(r"^\s"))


def _class(x: Column, known: Column) -> Column:
    t, plain = x["t"], x["plain"]
    bare = F.regexp_replace(t, r"\.$", "")
    stem = F.element_at(F.split(plain, "-"), 1)
    is_group = reduce(lambda a, b: a | b, [plain.endswith(g) | plain.startswith(g) for g in GROUPS])
    capital = t.rlike(r"^\p{Lu}")
    return (
        F.when(t.rlike(r"^\d+$"), "number").when(t.isin("(", "["), "open").when(t.isin(")", "]"), "close").when(t.isin(",", ";", "/"), "comma").when(t == ":", "colon")
        .when(plain.isin(*OTHERS), "others").when(is_group, "group").when(bare.isin(*PARTIES), "party").when(plain.isin(*TITLES), "title").when(plain.isin(*ANDS) & ~capital, "and")
        .when(t.rlike(r"^\p{Lu}\.$"), "initial").when(plain.isin(*PARTICLES), "particle").when(plain.isin(*LEADS), "word").when(capital & F.array_contains(known, stem), "first").when(capital, "capital").otherwise("word")
    )


_WORD = "struct<t: string, cls: string, at: bigint>"
_AUTHOR = f"struct<words: array<{_WORD}>, party: string, place: string>"


def _walk(line_tokens: Column) -> Column:
    steps = F.create_map(*[x for key, (state, action) in _table().items() for x in (F.lit(key), F.struct(F.lit(state).alias("state"), F.lit(action).alias("action")))])
    zero = F.struct(F.lit("start").alias("state"), F.array().cast(f"array<{_WORD}>").alias("words"), F.array().cast(f"array<{_AUTHOR}>").alias("authors"), F.array().cast("array<string>").alias("groups"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("int").alias("others"))
    author = lambda words: F.struct(words.alias("words"), F.lit(None).cast("string").alias("party"), F.lit(None).cast("string").alias("place"))

    def last_with(authors: Column, **new: Column) -> Column:
        """The last author with a party or, word by word, a place; the first party counts."""
        end = F.element_at(authors, -1)
        party = F.coalesce(end["party"], new["party"]) if "party" in new else end["party"]
        place = F.concat_ws(" ", end["place"], new["place"]) if "place" in new else end["place"]
        changed = F.concat(F.slice(authors, 1, F.size(authors) - 1), F.array(F.struct(end["words"].alias("words"), party.alias("party"), place.alias("place"))))
        return F.when(F.size(authors) > 0, changed).otherwise(authors)

    def moved(acc: Column, x: Column) -> Column:
        def done(step: Column) -> Column:
            action, word = step["action"], F.struct(x["t"].alias("t"), x["cls"].alias("cls"), x["at"].alias("at"))
            is_one = lambda *names: action.isin(*names)
            words = F.when(is_one("open", "next"), F.array(word)).when(is_one("add"), F.concat(acc["words"], F.array(word))).when(is_one("close", "close_party", "close_group", "as_place", "as_place_party", "as_place_group"), F.array().cast(f"array<{_WORD}>")).otherwise(acc["words"])
            pushed = F.concat(acc["authors"], F.array(author(acc["words"])))
            here = F.array_join(F.transform(acc["words"], lambda w: w["t"]), " ")
            authors = (
                F.when(is_one("close", "next", "close_group"), pushed).when(is_one("close_party"), last_with(pushed, party=x["t"])).when(is_one("party"), last_with(acc["authors"], party=x["t"])).when(is_one("place"), last_with(acc["authors"], place=x["t"]))
                .when(is_one("as_place", "as_place_group"), last_with(acc["authors"], place=here)).when(is_one("as_place_party"), last_with(acc["authors"], place=here, party=x["t"])).otherwise(acc["authors"])
            )
            grown = F.concat(F.slice(acc["groups"], 1, F.greatest(F.size(acc["groups"]) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(acc["groups"], -1), x["t"])))
            groups = F.when(is_one("group", "close_group", "as_place_group"), F.concat(acc["groups"], F.array(x["t"]))).when(is_one("group_add"), grown).otherwise(acc["groups"])
            number = F.when(x["cls"] == "number", x["t"].try_cast("int")).otherwise(acc["number"])
            others = F.when((x["cls"] == "others") & acc["number"].isNotNull(), acc["number"]).otherwise(acc["others"])
            return F.struct(step["state"].alias("state"), words.alias("words"), authors.alias("authors"), groups.alias("groups"), number.alias("number"), others.alias("others"))

        return T.let(F.element_at(steps, F.concat_ws("|", acc["state"], x["cls"])), done)

    def finished(acc: Column) -> Column:
        here = F.array_join(F.transform(acc["words"], lambda w: w["t"]), " ")
        rest = F.when(F.size(acc["words"]) == 0, acc["authors"]).when(acc["state"] == "maybe", last_with(acc["authors"], place=here)).otherwise(F.concat(acc["authors"], F.array(author(acc["words"]))))
        groups = F.transform(acc["groups"], lambda g: F.regexp_replace(g, r"\s(?:" + "|".join(ANDS) + r")$", ""))  # "the group and Anna ..."
        return F.struct(rest.alias("authors"), groups.alias("groups"), acc["others"].alias("others"))

    return F.aggregate(line_tokens, zero, moved, finished)


def _named(author: Column) -> Column:
    """(name, first, family, party, place, start, stop, known): parts of a name. A family name keeps its particles; its last word never is a first name, but for a family name in front."""
    words = F.filter(author["words"], lambda w: w["cls"] != "initial")

    def parts(w: Column) -> Column:
        plain = F.filter(w, lambda x: x["cls"] != "particle")
        n = F.size(plain)
        lead = F.least(F.coalesce(F.array_position(F.transform(w, lambda x: x["cls"] != "first"), True) - 1, F.lit(0)), F.size(w) - 1)
        lead = F.when(F.forall(w, lambda x: x["cls"] == "first"), F.size(w) - 1).otherwise(lead).cast("int")
        turned = (n == 2) & (F.get(plain, F.lit(0))["cls"] == "capital") & (F.get(plain, F.lit(1))["cls"] == "first")
        count = F.when(n <= 1, 0).when((lead == 0) & (n >= 2), 1).otherwise(lead)
        text = lambda a: F.array_join(F.transform(a, lambda x: x["t"]), " ")
        first = F.when(turned, F.element_at(w, -1)["t"]).otherwise(text(F.slice(w, 1, count)))
        family = F.when(turned, text(F.slice(w, 1, F.size(w) - 1))).otherwise(text(F.slice(w, count + 1, F.size(w))))
        end = F.element_at(author["words"], -1)
        return F.struct(
            text(author["words"]).alias("name"), first.alias("first"), family.alias("family"), author["party"].alias("party"), author["place"].alias("place"),
            F.get(author["words"], F.lit(0))["at"].alias("start"), (end["at"] + F.length(end["t"])).alias("stop"), F.exists(w, lambda x: x["cls"] == "first").alias("known"),
        )

    return T.let(words, parts)


def known_names(lines: DataFrame, key: list[str], line_tokens: str, names: DataFrame, small: int = SMALL) -> DataFrame:
    """``lines`` with ``known``, the plain forms of their words that the dictionary ``names`` (name) has.

    A dictionary of at most ``small`` words goes along as one row; with a larger one the words of the lines are joined.
    """
    words = names.select(T.fold_latin(F.col("name")).alias("word")).where("word <> ''").distinct()
    if words.limit(small + 1).count() <= small:
        row = words.agg(F.collect_set("word").alias("_names"))
        return lines.join(F.broadcast(row)).withColumn("known", F.array_intersect(F.transform(line_tokens, lambda x: F.element_at(F.split(x["plain"], "-"), 1)), "_names")).drop("_names")
    used = lines.select(*key, F.explode(F.array_distinct(F.transform(line_tokens, lambda x: F.element_at(F.split(x["plain"], "-"), 1)))).alias("word"))
    found = used.join(words, "word").groupBy(*key).agg(F.collect_set("word").alias("known"))
    return lines.join(found, key, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def read_authors(lines: DataFrame, key: list[str], text: str, names: DataFrame, small: int = SMALL) -> DataFrame:
    """``key`` (unique), authors (array), groups, others of lines that name who submitted something.

    An author has name, first, family, party, place, start and stop in the line, and whether a first name is known. ``others`` is the number
    of those who signed besides, null if none is stated. A line without a name gives an empty array.
    """
    cut = lines.select(*key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("_tokens"))
    marked = known_names(cut, key, "_tokens", names, small)
    classed = F.transform("_tokens", lambda x: F.struct(x["t"].alias("t"), x["at"].alias("at"), _class(x, F.col("known")).alias("cls")))
    walked = marked.withColumn("_r", _walk(classed))
    return walked.select(*key, F.transform("_r.authors", _named).alias("authors"), F.col("_r.groups").alias("groups"), F.col("_r.others").alias("others"))
