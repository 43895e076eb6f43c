"""Atoms: the smallest pieces of a document's blocks that an answer is given for, with their places in the text.

A block is cut at its line feeds; a line where a new frame (a part of the block on another page or in another column) begins, and
where a gap between two words is as wide as one between columns; a piece of over ``LONG`` characters at the ends of its sentences, and any piece
where a sentence ends and the next begins without a space. Rows of tables stay whole and get the places of their cells. Everything
is array operations within a block, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherum.functions import text as T
from gatherum.operators.sequence import starts_of

# Pieces longer than this are cut into sentences; a gap between columns is wider than this (in points) and than so many medians of the line's other gaps.
LONG, GAP, GAP_MEDIANS = 200, 18.0, 3.0
# Labels of blocks that are tables.
TABLES = ("table", "document_index")
# Words with which a numbered heading begins.
PARTS = ("art", "art.", "§", "annexe", "anhang", "allegato", "partie", "teil", "parte", "kapitel", "chapitre", "capitolo", "titre", "titel")
#: What stands before a hanging indent: a number, a letter or a Roman number with its mark, a numbered part, or a bullet.
_INDENT = r"(?iu)^\s*(?:[(\[]?\d{1,3}(?:\.\d{1,3}){0,3}[.):\]]*|[(\[]?\p{L}[.)\]]+|[ivx]{1,5}[.)]+|(?:" + "|".join(p.replace(".", r"\.") for p in PARTS) + r")\s*[\divx]+\p{L}*(?:\s+(?:bis|ter|quater))?[.):]*|[-–—•·*▪■□○◦►>]+)\s*$"

#: At the start of a text, at least as much as any beginning of it that is an indent.
_INDENT_STARTS = (r"(?iu)^\s*(?:" + "|".join(p.replace(".", r"\.") for p in PARTS) + r")\s*[\divx]+\p{L}*\s*(?:bis|ter|quater)?[.):\s]*", r"(?iu)^\s*[(\[]?\p{L}?[\d.():\[\]\sivx\-–—•·*▪■□○◦►>]*")


def _piece(x: Column, y: Column, cut: Column | str | None, own: Column) -> Column:
    cut = F.lit(cut).cast("string") if cut is None or isinstance(cut, str) else cut
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), cut.alias("cut"), own.alias("own"))


def _trimmed(own: Column, at: Column, cut: Column | str | None) -> Column:
    """The piece of a text, of which ``own`` stands at ``at``, without white space at its ends; null if nothing is left. It carries its text, as cutting that out anew reads all that stands before it."""
    stop = F.when(F.right(own, F.lit(1)).rlike(r"\s"), F.length(F.regexp_replace(own, r"(?<!\s)\s+$", ""))).otherwise(F.length(own))
    ends = F.struct(F.length(F.regexp_extract(own, r"^\s*", 0)).alias("lead"), stop.alias("stop"))
    return T.let(ends, lambda e: F.when(e["lead"] < F.length(own), _piece(at + e["lead"], at + e["stop"], cut, F.substr(own, e["lead"] + 1, e["stop"] - e["lead"]))))


def _some(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: p.isNotNull())


def median_of_others(sorted_values: Column, value: Column) -> Column:
    """The median of an array that is sorted, without one element of this value; null if there is no other."""
    n = F.size(sorted_values) - 1
    at = lambda k: T.let(F.get(sorted_values, k.cast("int")), lambda x: F.when(x < value, x).otherwise(F.get(sorted_values, k.cast("int") + 1)))  # noqa: E731 - the value stands at k or before it unless what stands there is smaller
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def column_cuts(words: Column, gap: float = GAP, medians: float = GAP_MEDIANS, indent: str | None = None) -> Column:
    """Places of words (text, start, x0, x1, in reading order, all of one line) before which a column begins.

    ``indent``: another pattern of the mark before a hanging indent, one without white space.
    """
    follow = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), follow.alias("b"))
    with_gaps = F.transform(pairs, lambda p: F.struct(p["b"]["start"].alias("start"), (p["b"]["x0"] - p["a"]["x1"]).alias("gap")))

    # An indent is at most as long as what the wider patterns find, so only gaps between so many first words are looked at.
    texts = F.transform(words, lambda w: w["text"])
    longest = lambda t, *patterns: F.greatest(F.lit(0), *[F.length(F.regexp_extract(t, p, 0)) for p in patterns])
    if indent:
        first = longest(F.array_join(texts, " "), r"^\s*\S*\s*") + 1
    else:
        either = lambda t: T.let(t, lambda one: longest(one, *_INDENT_STARTS))
        first = F.greatest(either(F.array_join(texts, " ")), either(F.array_join(texts, "")) + F.size(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) == ""))) + 1

    def chosen(gaps: Column) -> Column:
        sizes = F.transform(gaps, lambda g: g["gap"])
        ordered = F.concat(F.sort_array(F.filter(sizes, lambda x: x.isNotNull())), F.filter(sizes, lambda x: x.isNull()))
        others = lambda g, o: F.coalesce(median_of_others(o, g["gap"]) * medians, F.lit(float("-inf")))
        left = lambda g: F.filter(words, lambda w: w["start"] < g["start"])
        told = lambda t: F.array_join(t, " ").rlike(rf"^\s*(?:{indent})\s*\z") if indent else F.array_join(t, " ").rlike(_INDENT) | F.array_join(t, "").rlike(_INDENT)
        hangs = lambda g: T.let(F.transform(left(g), lambda w: w["text"]), told)
        wide = T.let(ordered, lambda o: F.filter(gaps, lambda g: (g["gap"] > gap) & (g["gap"] > others(g, o))))
        far = lambda n: F.coalesce(F.get(words, n)["start"], F.lit((1 << 31) - 1))
        told_apart = lambda found: T.let(far(first), lambda stop: F.filter(found, lambda g: (g["start"] >= stop) | ~hangs(g)))
        return F.transform(T.let(wide, lambda found: F.when(F.size(found) > 0, told_apart(found)).otherwise(found)), lambda g: g["start"])

    return F.when(F.size(words) > 1, T.let(with_gaps, chosen)).otherwise(F.array().cast("array<int>"))


def _spread(piece: Column, cut_up: Column, name: str) -> Column:
    """A piece as those that its own text is cut into, if there are several; ``cut_up`` joined is that text."""
    placed = T.let(cut_up, lambda c: _some(F.zip_with(c, starts_of(F.transform(c, lambda s: F.length(s).cast("long"))), lambda s, at: _trimmed(s, piece["x"] + at, name))))
    return T.let(placed, lambda p: F.when(F.size(p) > 1, p).otherwise(F.array(piece)))


def _parts_of_line(line: Column, cuts: Column, table: Column, long: int, unspaced: bool) -> Column:
    """Pieces of a line between ``cuts`` (at, kind), and their sentences."""
    def cut(inside: Column) -> Column:
        kinds = F.array_sort(F.array_distinct(F.transform(inside, lambda c: c["kind"])))
        kind = F.when(F.size(kinds) == 0, F.lit(None).cast("string")).when(F.size(kinds) == 2, "frame_column").otherwise(F.get(kinds, F.lit(0)))
        places = F.transform(inside, lambda c: c["at"])
        bounds = lambda k: F.zip_with(F.concat(F.array(F.lit(0)), places), F.concat(places, F.array(F.length(line))), lambda a, b: _trimmed(F.substr(line, a + 1, b - a), a, k))
        return _some(T.let(kind, bounds))

    inside = T.let(F.length(line), lambda end: F.filter(cuts, lambda c: (c["at"] > 0) & (c["at"] < end)))
    pieces = T.let(F.array_sort(inside), cut)
    spaced = F.flatten(F.transform(pieces, lambda p: F.when(~table & (p["y"] - p["x"] > long), _spread(p, T.sentence_pieces(p["own"]), "sentence")).otherwise(F.array(p))))
    apart = lambda p: F.when(~table & T.has_unspaced(p["own"]), _spread(p, T.unspaced_pieces(p["own"]), "sentence_no_space")).otherwise(F.array(p))
    return spaced if not unspaced else F.flatten(F.transform(spaced, apart))


def atoms(blocks: DataFrame, doc: str, block: str, text: str, label: str | None = None, frames: str | None = None, words: str | None = None, long: int = LONG, unspaced: bool = True, indent: str | None = None) -> DataFrame:
    """(doc, block, id, line, part, cut, start, stop, text, frame, cells) of the blocks of documents; ``start`` and ``stop`` are places in the block's text (code points).

    ``frames``: array of the places at which a frame begins (0 may be left out); ``words``: for each line the array of its
    words (text, start, x0, x1), with their places in the block's text and across the page. ``part`` numbers the pieces of a line that has several,
    ``cut`` says what they were cut by. Rows of tables are cut by frames and columns only; ``cells`` has the places of their cells
    between tabulators. ``long`` and ``unspaced`` say whether sentences are cut apart, ``indent`` what mark stands before a hanging indent (a pattern) instead of those that are listed. A block without text is one empty atom; a null text is none.
    """
    none = F.array().cast("array<int>")
    t = F.coalesce(F.col(text), F.lit(""))
    table = F.coalesce(F.col(label).isin(*TABLES), F.lit(False)) if label else F.lit(False)
    framed = F.transform(F.coalesce(F.col(frames), none), lambda a: a.cast("int")) if frames else none
    raw = F.split(t, "\n", -1)
    none_of = F.array().cast(blocks.schema[words].dataType.elementType) if words else None
    by_line = {"words": F.coalesce(F.col(words), F.array().cast(blocks.schema[words].dataType))} if words else {}
    placed = F.arrays_zip(raw.alias("raw"), starts_of(F.transform(raw, lambda s: F.length(s).cast("long") + 1)).alias("at"), *[c.alias(n) for n, c in by_line.items()])
    lined = blocks.select(doc, block, table.alias("_table"), framed.alias("_frames"), placed.alias("_lines"))
    mark = lambda a, kind: F.transform(a, lambda p: F.struct(p.cast("int").alias("at"), F.lit(kind).alias("kind")))
    # Rows of lines first: within one expression the arrays of the whole text would be made anew for each line. What stands in ``l`` is exploded, so it is made once.
    # An explode that isn't outer would be given a filter on the array's size, for which the array with all words is made a second time.
    each_line = lined.select(doc, block, "_table", "_frames", F.posexplode_outer("_lines").alias("_row", "_line")).where("_line.raw is not null")
    base, line = F.col("_line.at").cast("int"), F.col("_line.raw")
    columns = F.array_except(column_cuts(F.coalesce(F.col("_line.words"), none_of), indent=indent), F.col("_frames")) if words else none
    here = T.let(base + F.length(line), lambda end: F.filter(F.concat(mark(F.col("_frames"), "frame"), mark(columns, "column")), lambda c: (c["at"] > base) & (c["at"] < end)))
    cuts = F.transform(here, lambda c: F.struct((c["at"] - base).alias("at"), c["kind"].alias("kind")))
    found = T.let(cuts, lambda c: _parts_of_line(line, c, F.col("_table"), long, unspaced))
    rows = each_line.select(doc, block, "_table", "_frames", F.explode(F.array(F.struct((F.col("_row") + 1).cast("int").alias("line"), base.alias("at"), found.alias("parts")))).alias("l"))
    each = rows.select(doc, block, "_table", "_frames", F.col("l.line").alias("line"), F.col("l.at").alias("_at"), F.size("l.parts").alias("_n"), F.posexplode("l.parts").alias("_k", "p"))
    part = F.when(F.col("_n") > 1, F.col("_k") + 1)
    own = F.col("p.own")
    tabbed = F.split(own, "\t", -1)
    cells = F.zip_with(tabbed, starts_of(F.transform(tabbed, lambda s: F.length(s).cast("long") + 1)), lambda s, at: _trimmed(s, F.col("p.x") + at, None))
    found = each.select(
        doc, block, F.concat_ws(".", F.col(block).cast("string"), F.col("line").cast("string"), part.cast("string")).alias("id"), "line", part.alias("part"), F.when(part.isNotNull(), F.col("p.cut")).alias("cut"),
        (F.col("_at") + F.col("p.x")).alias("start"), (F.col("_at") + F.col("p.y")).alias("stop"), own.alias("text"), F.size(F.filter("_frames", lambda a: (a > 0) & (a <= F.col("_at") + F.col("p.x")))).alias("frame"),
        F.when(F.col("_table"), F.transform(_some(cells), lambda q: F.struct((F.col("_at") + q["x"]).alias("start"), (F.col("_at") + q["y"]).alias("stop")))).alias("cells"),
    )
    empty = blocks.where(F.trim(F.regexp_replace(t, r"\s+", "")) == "").select(
        doc, block, F.concat_ws(".", F.col(block).cast("string"), F.lit("1")).alias("id"), F.lit(1).alias("line"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("string").alias("cut"),
        F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("").alias("text"), F.lit(0).alias("frame"), F.lit(None).cast("array<struct<start: int, stop: int>>").alias("cells"),
    )
    return found.unionByName(empty)
