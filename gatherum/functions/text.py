"""Text functions as column expressions; Python only where Spark has no primitive (Unicode normalisation, offset maps)."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: Letters of the Latin alphabets in use here and what is left of them without marks.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
_BARE = "aaaaaaceeeeiiiinoooooouuuuyy"
# Typographic characters and their plain forms; characters without width.
PLAIN = {
    "\u2019": "'", "\u2018": "'", "\u02bc": "'", "\u00b4": "'", "`": "'", "\u2039": "'", "\u203a": "'",
    "\u00ab": '"', "\u00bb": '"', "\u201c": '"', "\u201d": '"', "\u201e": '"',
    "\u2013": "-", "\u2014": "-", "\u2010": "-", "\u2011": "-", "\u2212": "-",
    "\u00a0": " ", "\u202f": " ", "\u2009": " ", "\u2007": " ",
}
NO_WIDTH = "\u00ad\u200b\u200c\u200d\ufeff"
# Words that carry no content, and words that tell a language.
STOP_WORDS = "der die das des dem den und in im zu zur zum von vom fuer fur auf an am ein eine einer eines mit bei aus als ist de la le les du des et en au aux un une pour sur dans par a l d di del della dei delle il lo i gli e per con su nel nella al alla da un una".split()
LANGUAGE_WORDS = {
    "de": "der die das und nicht ist mit von den des dem ein eine werden wird für auf im zu sich dass".split(),
    "fr": "le la les des et est une dans pour que qui du au aux pas sur par ce cette sont".split(),
    "it": "il lo la gli le di che è per una del della dei delle nel con non sono alla si".split(),
}


def folded(text: Column) -> Column:
    """Small letters; also of the four odd letters that patterns take for i, s and k where case doesn't count."""
    for odd, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")):
        text = F.replace(text, F.lit(odd), F.lit(plain))
    return F.lower(text)


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is in the text, anywhere. Far cheaper than a pattern, so it may go before one that can't match without them."""
    return reduce(Column.__or__, [text.contains(w) for w in words])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(c: Column) -> Column:
    """True if a value is there: not null and more than white space."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_present(*columns: Column) -> Column:
    """The first value that is there, of a family of language columns."""
    return F.coalesce(*map(blank_to_null, columns))


def fold_latin(c: Column) -> Column:
    """Comparison form of Latin text: lower case, no marks, sharp s as ss, other characters as one space. JVM only."""
    low = F.translate(F.regexp_replace(F.lower(F.regexp_replace(c, "\u00ad", "")), "ß", "ss"), _MARKED, _BARE)
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def _is_mark(c: str) -> bool:
    return unicodedata.category(c) == "Mn"


def fold_value(s: str | None) -> str:
    """The comparison form of a text in any script: compatibility composition, then as ``fold_latin`` for all marks."""
    low = unicodedata.normalize("NFKC", s or "").replace("\u00ad", "").replace("ß", "ss").lower()
    bare = low if low.isascii() else "".join(itertools.filterfalse(_is_mark, unicodedata.normalize("NFD", low)))
    return " ".join(re.findall("[a-z0-9]+", bare))


def norm_value(s: str | None) -> str:
    """Compatibility composition, plain quotes and dashes, words joined over line ends, single spaces; case and marks stay."""
    plain = unicodedata.normalize("NFKC", s or "").translate(_PLAIN_TABLE)
    return " ".join(_BROKEN.sub(r"\1\2", plain).split())


# Text by text, not by functions on the whole batch: those hold each step, and the words, of all texts of a batch at a time.
@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    return texts.map(fold_value)


_PLAIN_TABLE = str.maketrans(PLAIN | dict.fromkeys(NO_WIDTH))


_BROKEN = re.compile(r"([^\W\d_])-[ \t]*\n[ \t]*([a-zà-ÿ])")


@F.pandas_udf(StringType())
def norm(texts: pd.Series) -> pd.Series:
    return texts.map(norm_value)


@lru_cache(maxsize=1 << 16)
def _searched_as(point: int) -> tuple[int, ...]:
    """What a character is in a form for searches: code points in lower case without marks, one space for white space, nothing for what has no width."""
    c = chr(point)
    if c in NO_WIDTH:
        return ()
    parts = "ss" if c == "ß" else itertools.filterfalse(_is_mark, unicodedata.normalize("NFKD", PLAIN.get(c, c)))
    return tuple(32 if x.isspace() else ord(x) for x in "".join(parts).lower())


def search_forms(texts: list[str]) -> list[tuple[str, np.ndarray]]:
    """For each text a form for searches (lower case, no marks, runs of white space as one space; punctuation stays) and the source offset of each of its characters.

    The characters of a batch are looked up once each; forms and offsets are built by array operations.
    """
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    known = np.unique(np.concatenate(points)) if points else np.zeros(0, dtype="<u4")
    forms = [_searched_as(int(c)) for c in known]
    width = np.array([len(f) for f in forms], dtype=np.int64)
    letters = np.array([x for f in forms for x in f], dtype="<u4")
    begin = np.cumsum(width) - width
    out = []
    for p in points:
        kind = np.searchsorted(known, p)
        n = width[kind]
        source = np.repeat(np.arange(len(p)), n)
        inner = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n)
        form = letters[np.repeat(begin[kind], n) + inner] if len(source) else letters[:0]
        blank = form == 32
        kept = ~(blank & np.r_[False, blank[:-1]])
        out.append((form[kept].tobytes().decode("utf-32-le", "surrogatepass"), source[kept]))
    return out


def search_form(s: str) -> tuple[str, list[int]]:
    form, offsets = search_forms([s])[0]
    return form, offsets.tolist()


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("offsets", ArrayType(IntegerType()))]))
def search_map(texts: pd.Series) -> pd.DataFrame:
    forms = search_forms([t or "" for t in texts])
    return pd.DataFrame({"text": [f[0] for f in forms], "offsets": [f[1].astype(np.int32) for f in forms]})


def words_of(c: Column) -> Column:
    """Words of a folded text."""
    return F.filter(F.split(fold_latin(c), " "), lambda x: x != "")


def content_words(c: Column) -> Column:
    return F.filter(words_of(c), lambda x: ~x.isin(STOP_WORDS))


def word_overlap(a: Column, b: Column) -> Column:
    """Common words by the larger set's size; 0 if a set is empty."""
    x, y = F.array_distinct(words_of(a)), F.array_distinct(words_of(b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(F.lit(0.0))


def titles_equal(a: Column, b: Column) -> Column:
    """Equal folded, or five times the common words is at least four times the larger set; empty forms never are."""
    x, y = F.array_distinct(words_of(a)), F.array_distinct(words_of(b))
    near = F.size(F.array_intersect(x, y)) * 5 >= F.greatest(F.size(x), F.size(y)) * 4
    return (fold_latin(a) != "") & (fold_latin(b) != "") & ((fold_latin(a) == fold_latin(b)) | near)


def share_of_words(a: Column, b: Column) -> Column:
    """Share of the content words of ``a`` that ``b`` has too; 0 if there are none."""
    x = content_words(a)
    return F.when(F.size(x) > 0, let(content_words(b), lambda y: F.size(F.filter(x, lambda w: F.array_contains(y, w)))) / F.size(x)).otherwise(F.lit(0.0))


def number_runs(c: Column) -> Column:
    """Runs of letters and of digits of the folded form, without leading zeros; null if there are none."""
    runs = F.transform(F.regexp_extract_all(fold_latin(c), F.lit("[a-z]+|[0-9]+"), F.lit(0)), lambda r: F.regexp_replace(r, r"^0+(?=\d)", ""))
    return F.when(F.size(runs) > 0, runs)


def number_class(c: Column) -> Column:
    """S1: five digits or more and nothing else; S2: eight hexadecimal digits in lower case; else null."""
    return F.when(F.trim(c).rlike("^[0-9]{5,}$"), "S1").when(F.trim(c).rlike("^[0-9a-f]{8}$"), "S2")


def plausible_number(number: Column, external_id: Column) -> Column:
    """Looks like an official number: there, no bare hexadecimal key, and no long number that only repeats the system's id."""
    n = F.trim(number)
    digits = n.rlike("^[0-9]+$")
    hexed = n.rlike("(?i)^[0-9a-f]{8,}$") & ~digits
    return present(number) & ~F.coalesce(hexed, F.lit(False)) & ~F.coalesce(digits & (F.length(n) >= 5) & (F.trim(external_id) == n), F.lit(False))


def is_part(short: Column, long: Column) -> Column:
    """One word list is a gap-free, non-empty part of the other."""
    n, m = F.size(short), F.size(long)
    return F.when((n > 0) & (n <= m), F.exists(F.sequence(F.lit(0), m - n), lambda i: F.slice(long, i + 1, n) == short)).otherwise(F.lit(False))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def text_key(c: Column) -> Column:
    """First 16 hex digits of the MD5 of the text with collapsed white space."""
    return F.left(F.md5(collapsed(c).cast("binary")), F.lit(16))


def char_statistics(c: Column) -> dict[str, Column]:
    return {
        "n_chars": F.length(c).cast("long"),
        "n_solid": F.length(F.regexp_replace(c, r"\s+", "")).cast("long"),
        "n_letters": F.length(F.regexp_replace(c, r"[^\p{L}]+", "")).cast("long"),
        "n_junk": F.length(F.regexp_replace(c, r"[^\uE000-\uF8FF\uFFFD]+", "")).cast("long"),
    }


def head_has(c: Column, pattern: str, window: int = 3000) -> Column:
    """A marker in the head of a text, in any case."""
    return F.lower(F.left(c, F.lit(window))).rlike(pattern)


def without_tags(c: Column) -> Column:
    return collapsed(F.regexp_replace(c, "<[^>]*>", " "))


def furniture_key(c: Column) -> tuple[Column, Column]:
    """(letters, digits) of a line without page-number parts: what repeats in headers and footers."""
    numbered = F.regexp_replace(F.lower(c), r"(?:seite|page|pagina|p\.)?\s*\d+\s*(?:/|von|de|di|of)\s*\d+", "")
    bare = F.when(c.rlike("[0-9]"), numbered).otherwise(F.lower(c))  # few lines have a digit, and the pattern tries each place
    return F.regexp_replace(bare, r"[^\p{L}]+", ""), F.regexp_replace(bare, r"[^0-9]+", "")


def contract_spaced(c: Column) -> Column:
    """Letter-spaced words as words: single letters with single spaces between them, four or more."""
    return F.when(c.rlike(r"^\s*(?:\p{L} ){3,}\p{L}\s*$"), F.regexp_replace(c, " ", "")).otherwise(c)


def bullet(c: Column) -> tuple[Column, Column]:
    """(mark, rest) of a line that starts as a list item; a date is none."""
    form = r"^\s*((?:[-•–*]|\(?\d{1,3}[.)]|\(?[a-z][.)]))\s+(?!\d{1,2}\.\s*\d{2,4})(.*)$"
    return blank_to_null(F.regexp_extract(c, form, 1)), F.coalesce(blank_to_null(F.regexp_extract(c, form, 2)), c)


#: Where a sentence ends: an end mark, not behind an initial, an ordinal or a known abbreviation.
_ENDS = r"(?<=[.!?])(?<!\b\p{Lu}\.)(?<!\d\.)(?<!\b(?:Dr|Nr|Art|Abs|bzw|ca|St|Mr|Mme|etc)\.)"


def split_after(c: Column, mark: str, place: str) -> Column:
    """The text cut at each place without width that stands behind a mark of one character; places don't follow each other directly. ``split`` would compile the pattern anew for each text."""
    at_once = F.split(F.regexp_replace(c, f"({mark}){place}", "$1\0"), "\0", -1)
    return F.when(F.contains(c, F.lit("\0")), F.split(c, place, -1)).otherwise(at_once)


def sentences(c: Column) -> Column:
    """Sentences: an end mark and white space before a capital; not behind an initial, an ordinal or a known abbreviation."""
    return F.filter(F.split(c, _ENDS + r"\s+(?=[\p{Lu}«\"])"), lambda s: F.trim(s) != "")


def sentence_pieces(c: Column) -> Column:
    """The text cut at the same places; joined, the pieces are the text. White space goes with what follows it."""
    return split_after(c, r"[.!?]", _ENDS + r"(?=\s+[\p{Lu}«\"])")


#: A token that is an address, a path, a file or a query, in which an end mark before a capital ends no sentence.
_ADDRESS = r"@|://|www\.|/\w+/|\.(?:ch|com|de|fr|it|org|net|pdf|docx?)\b|[?&]\w+="


def has_unspaced(c: Column) -> Column:
    """Whether a capital stands right behind an end mark, without which ``unspaced_pieces`` cuts nothing."""
    return c.rlike(r"[.!?]\p{Lu}")


def unspaced_pieces(c: Column) -> Column:
    """A text cut where a sentence ends and the next begins without a space ("... zu Ende.Am ..."): an end mark between a lower-case letter or a closing mark and
    a capital with a lower-case letter. Not behind an abbreviation or a single letter, also as the last part of a word with a hyphen, and not in addresses, paths and queries.
    Joined, the pieces are the text.
    """
    place = r"(?<=[\p{Ll}\p{N})»\"][.!?])(?<!\b(?:Dr|Nr|Art|Abs|bzw|ca|St|Mr|Mme|etc)\.)(?<!\b\p{L}\.)(?=[\p{Lu}][\p{Ll}])"
    tokens = F.regexp_extract_all(c, F.lit(r"(?s)\S+|\s+"), F.lit(0))
    marked = F.transform(tokens, lambda t: F.when(t.rlike(_ADDRESS), t).otherwise(F.regexp_replace(t, r"([.!?])" + place, "$1\x1e")))
    return F.when(has_unspaced(c), F.split(F.array_join(marked, ""), "\x1e", -1)).otherwise(F.array(c))


def sentences_without_space(c: Column) -> Column:
    """The pieces of ``unspaced_pieces`` without white space around them, and without empty ones."""
    return F.filter(F.transform(unspaced_pieces(c), F.trim), lambda x: x != "")


def snippet(c: Column, start: Column, stop: Column, width: int = 120) -> Column:
    """At most ``width`` characters around a span (code points, stop exclusive), with marks where text is left out."""
    room = F.greatest(F.lit(width) - (stop - start), F.lit(0))
    first = F.greatest(F.least(start - F.floor(room / 2), F.length(c) - width), F.lit(0)).cast("int")
    cut = F.substr(c, first + 1, F.lit(width))
    return F.concat(F.when(first > 0, "…").otherwise(""), cut, F.when(first + width < F.length(c), "…").otherwise(""))


def guess_language(c: Column, window: int = 20_000) -> Column:
    """The language with most of its words in the head: three hits, and over one and a half times the second; else null."""
    words = F.regexp_extract_all(F.lower(F.left(c, F.lit(window))), F.lit(r"\p{L}+"), F.lit(0))
    hits = let(words, lambda w: F.array(*[F.struct(_hits(w, k), F.lit(lang)) for lang, k in LANGUAGE_WORDS.items()]))
    ranked = F.sort_array(hits, asc=False)
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.when((best["col1"] >= 3) & (best["col1"] * 2 > second["col1"] * 3), best["col2"])


def _hits(words: Column, known: list[str]) -> Column:
    return F.size(F.filter(words, lambda x: x.isin(known)))


def word_multiset_missing(a: Column, b: Column) -> Column:
    """How many words of ``a`` (repeats count) ``b`` lacks: the completeness of an extraction."""
    counts = lambda w: F.aggregate(w, F.lit(0), lambda acc, x: acc + 1)
    x, y = words_of(a), words_of(b)
    distinct = F.array_distinct(x)
    short = F.transform(distinct, lambda w: F.greatest(counts(F.filter(x, lambda v: v == w)) - counts(F.filter(y, lambda v: v == w)), F.lit(0)))
    return F.aggregate(short, F.lit(0), lambda acc, v: acc + v)


def is_verbatim(visible: Column, source: Column) -> Column:
    """The visible text has the letters and digits of the source, in order."""
    solid = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")
    return solid(without_tags(visible)) == solid(source)


def forbidden_in_xml(c: Column) -> Column:
    """Characters that XML 1.0 does not allow."""
    return F.regexp_extract_all(c, F.lit(r"[^\x09\x0A\x0D\x20-\uD7FF\uE000-\uFFFD\x{10000}-\x{10FFFF}]"), F.lit(0))


def html_escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, 1 for equal texts."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def percent_encode(c: Column | str) -> Column:
    """All but letters, digits and -._~ as percent-encoded UTF-8."""
    form = F.url_encode(c)
    for made, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        form = F.replace(form, F.lit(made), F.lit(wanted))
    return form


_WORD_LETTER = re.compile(r"\w")


def _last_word(line: str) -> str:
    """The word before a hyphen at the end of a line; nothing else of the line is looked at."""
    k = len(line) - 1
    while k > 0 and _WORD_LETTER.match(line[k - 1]):
        k -= 1
    return line[k:-1]


def join_hyphenated(lines: Iterator[str] | list[str], vocabulary: set[str]) -> str:
    """Lines as running text; a hyphen at a line end goes if the joined word is known, else it stays. Each line is looked at once, not all text before it."""
    out: list[str] = []
    open_word = ""  # what stands before the hyphen at the end of the text so far
    for line in lines:
        line = line.strip()
        if not line:
            continue
        n = re.match(r"(\w+)", line)
        held = ""
        if open_word and n and line[:1].islower():
            if (open_word + n.group(1)).lower() in vocabulary:
                out[-1] = out[-1][:-1]
                held = open_word
        elif out:
            out.append(" ")
        out.append(line)
        word = _last_word(line) if line[-1] == "-" else ""
        open_word = held + word if word and len(word) == len(line) - 1 else word
    return "".join(out)
