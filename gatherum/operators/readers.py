"""Value readers: a registry of functions that find candidates, and the choice of the best tier per field.

A reader takes (blocks or lines of documents) and returns candidates: doc_id, field, tier, tier_rank, value, start, stop.
"""

from __future__ import annotations

import importlib
import pkgutil
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatherum.functions import text as T
from gatherum.operators.rules import first_candidate

CANDIDATE = ("doc_id", "field", "tier", "tier_rank", "value", "start", "stop")
_READERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(field: str) -> Callable:
    """Decorator: the reader of a field. A field has one reader."""

    def add(reader: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        if field in _READERS:
            raise ValueError(f"{field} has a reader")
        _READERS[field] = reader
        return reader

    return add


def fields() -> list[str]:
    return sorted(_READERS)


#: By name, words in small letters, and the parts of patterns that match only in a line that has one of them.
_MARKS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {}


def register_mark(name: str, words: tuple[str, ...], *parts: str) -> None:
    """Tiers whose pattern has one of the parts look only at lines with one of the words."""
    _MARKS[name] = (words, parts)


@dataclass(frozen=True)
class Tier:
    """``pattern`` finds a value (its first group that took part) in lines that the scope, the roles and the neighbours admit.

    Lines without the marks of its parts are passed over; ``loose`` names marks whose part the pattern can do without, ``needs`` further marks.

    Scopes: all, first6, head (15 lines), head25, late_head (16 to 40), page1 (60), tail (15), last3. Roles: all, proposal,
    response, other, not_proposal, not_response. ``above`` and ``below`` are patterns of the next lines that aren't blank.
    """

    name: str
    pattern: str
    scope: str = "all"
    roles: str = "all"
    above: str | None = None
    below: str | None = None
    loose: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()

    @property
    def marks(self) -> list[str]:
        return [m for m, (_, parts) in _MARKS.items() if m in self.needs or (m not in self.loose and any(p in self.pattern for p in parts))]

    @property
    def evidence(self) -> int:
        """How many lines below the value its evidence stands: the line above or below that the tier asks for, or its own."""
        return 1 if self.below else -1 if self.above else 0

    def value(self) -> Column:
        """The value in a line with a column ``_has`` for the marks; what is cheap is asked first."""
        line, rest = F.col("line"), F.col("n_lines") - F.col("line")
        scopes = {"all": None, "first6": line < 6, "head": line < 15, "head25": line < 25, "late_head": (line >= 15) & (line < 40), "page1": line < 60, "tail": rest <= 15, "last3": rest <= 3}
        conditions = [*[F.col(f"_has.{m}") for m in self.marks], scopes[self.scope]]
        if self.roles != "all":
            wanted = F.col("role") == self.roles.removeprefix("not_")
            conditions.append(~wanted if self.roles.startswith("not_") else wanted)
        conditions += [F.col(c).rlike(p) for c, p in (("above", self.above), ("below", self.below)) if p is not None]
        groups = re.compile(re.sub(r"\\p\{L[ul]?\}", "x", self.pattern).replace("++", "+")).groups
        out = F.coalesce(*[F.nullif(F.regexp_extract("text", self.pattern, g), F.lit("")) for g in range(1, groups + 1)])
        for c in reversed(conditions):
            out = out if c is None else F.when(c, out)
        return out


_TIERS: dict[str, list[Tier]] = {}
#: Fields in which the first line with a candidate decides, and only then the tier.
_LINE_FIRST: set[str] = set()
#: For a field, why a candidate is refused: a function of (line, value, place of the value in the line) that gives a cause or null.
_REFUSALS: dict[str, Callable[[Column, Column, Column], Column]] = {}


def register_tiers(field: str, tiers: list[Tier], line_first: bool = False, needs: tuple[str, ...] = ()) -> None:
    """A field whose reader is a ranked list of tiers; ``needs`` are marks that all of them want."""
    tiers = [replace(t, needs=t.needs + needs) for t in tiers]
    _TIERS[field] = tiers
    if line_first:
        _LINE_FIRST.add(field)
    register(field)(lambda lines: tier_candidates(lines, field, tiers))


def register_refusals(field: str, cause: Callable[[Column, Column, Column], Column]) -> None:
    _REFUSALS[field] = cause


def discover(package: str, prefix: str = "tiers") -> list[str]:
    """Import all modules of a package whose names begin so; their readers register themselves. Gives their names."""
    found = sorted(m.name for m in pkgutil.iter_modules(importlib.import_module(package).__path__) if m.name.startswith(prefix))
    for name in found:
        importlib.import_module(f"{package}.{name}")
    return found


def tier_table(spark: SparkSession) -> DataFrame:
    """(field, tier_rank, tier, scope, roles, pattern): the registered tiers as rows."""
    rows = [(f, k, t.name, t.scope, t.roles, t.pattern) for f, ts in sorted(_TIERS.items()) for k, t in enumerate(ts, 1)]
    return spark.createDataFrame(rows, "field string, tier_rank int, tier string, scope string, roles string, pattern string")


def reader_lines(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines as readers want them: with the number of lines, the role of the document and the neighbours that aren't blank.

    ``documents``: doc_id, role; ``lines``: doc_id, line, text, start.
    """
    w = Window.partitionBy("doc_id").orderBy("line")
    solid = F.when(F.trim("text") != "", F.col("text"))
    sized = lines.withColumns({
        "above": F.last(solid, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "below": F.first(solid, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        "n_lines": F.count("*").over(Window.partitionBy("doc_id")),
    })
    return sized.join(documents.select("doc_id", "role"), "doc_id", "left").withColumn("role", F.coalesce("role", F.lit("other")))


def tier_candidates(lines: DataFrame, field: str, tiers: list[Tier]) -> DataFrame:
    """One row per tier and line with a match; offsets are those of the value in the document, ``line`` is that of its evidence, ``refused`` is the cause if it may not be used."""
    return _tier_rows(lines, {field: tiers})


def _tier_rows(lines: DataFrame, tiers: dict[str, list[Tier]]) -> DataFrame:
    """``tier_candidates`` of several fields. A line is read once for all tiers of all fields, and only tiers with a value become rows."""
    ranked = [(f, k, t) for f, ts in tiers.items() for k, t in enumerate(ts, 1)]
    marks = sorted({m for *_, t in ranked for m in t.marks})
    marked = lines.withColumn("_folded", T.folded(F.col("text")))
    if marks:
        marked = marked.withColumn("_has", F.struct(*[T.holds_any(F.col("_folded"), _MARKS[m][0]).alias(m) for m in marks]))
    found = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t.name).alias("tier"), F.lit(k).alias("tier_rank"), t.value().alias("value"), F.lit(t.evidence).alias("evidence")) for f, k, t in ranked]), lambda x: x["value"].isNotNull())
    rows = marked.select("doc_id", "line", "text", "start", F.explode(found).alias("x")).withColumn("at", F.expr("locate(x.value, text)") - 1)
    begin = F.col("start") + F.col("at")
    cause = F.lit(None).cast("string")
    for f in tiers:
        if f in _REFUSALS:
            cause = F.when(F.col("x.field") == f, _REFUSALS[f](F.col("text"), F.col("x.value"), F.col("at"))).otherwise(cause)
    return rows.select("doc_id", "x.field", "x.tier", "x.tier_rank", "x.value", begin.cast("long").alias("start"), (begin + F.length("x.value")).cast("long").alias("stop"), (F.col("line") + F.col("x.evidence")).cast("int").alias("line"), cause.alias("refused"))


_FULL = (*CANDIDATE, "line", "refused")


def _read_field(lines: DataFrame, field: str, strict: bool) -> DataFrame:
    """Candidates of one field; where the reader can't be built, an error, or without ``strict`` one row with the cause reader_error for each document."""
    try:
        rows = _READERS[field](lines)
    except Exception:
        if strict:
            raise
        rows = lines.select("doc_id").distinct().withColumns({"field": F.lit(field), "refused": F.lit("reader_error")})
    missing = {c: F.lit(None).cast("long" if c in ("start", "stop") else "int" if c in ("tier_rank", "line") else "string") for c in _FULL if c not in rows.columns}
    return rows.withColumns(missing).select(*_FULL)


def _can_be_built(tiers: list[Tier]) -> bool:
    try:
        return all(t.value() is not None for t in tiers)
    except Exception:
        return False


def read(lines: DataFrame, wanted: list[str] | None = None, documents: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """The first candidate of each document and field that isn't refused; with ``documents`` (doc_id) also rows with found = false and the reason.

    Reasons are no_text (only blank lines), no_reader, reader_error, the cause why the first candidate was refused, or no_candidate.
    """
    fields_wanted = wanted or fields()
    known = [f for f in fields_wanted if f in _READERS]
    if strict and len(known) < len(fields_wanted):
        raise KeyError(f"no reader for {sorted(set(fields_wanted) - set(known))}")
    listed = {f: _TIERS[f] for f in known if f in _TIERS and (strict or _can_be_built(_TIERS[f]))}
    parts = ([_tier_rows(lines, listed).select(*_FULL)] if listed else []) + [_read_field(lines, f, strict) for f in known if f not in listed]
    candidates = reduce(DataFrame.unionByName, parts).withColumn("_by_line", F.when(F.col("field").isin(*_LINE_FIRST), F.col("line")).otherwise(0) if _LINE_FIRST else F.lit(0))
    usable = candidates.where("refused is null").withColumn("_rank", F.struct(F.coalesce("_by_line", F.lit(0)).alias("l"), F.col("tier_rank").alias("t")))
    best = first_candidate(usable, ["doc_id", "field"], "_rank").select(*CANDIDATE, "n_others").withColumn("found", F.lit(True))
    if documents is None:
        return best
    causes = candidates.where("refused is not null").groupBy("doc_id", "field").agg(F.min_by("refused", F.struct(F.coalesce("_by_line", F.lit(0)).alias("l"), F.col("tier_rank").alias("t"), F.col("start").alias("s"))).alias("cause"))
    silent = lines.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.trim("text") != ""), F.lit(False)).alias("_says"))
    grid = documents.select("doc_id").distinct().join(silent, "doc_id", "left").withColumn("field", F.explode(F.array(*map(F.lit, fields_wanted))))
    joined = grid.join(best, ["doc_id", "field"], "left").join(causes, ["doc_id", "field"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    reason = F.when(~F.col("field").isin(*known) if known else F.lit(True), "no_reader").when(~F.coalesce("_says", F.lit(False)), "no_text").otherwise(F.coalesce("cause", F.lit("no_candidate")))
    return joined.withColumn("reason", F.when(~F.col("found"), reason)).drop("cause", "_says")


def combine(rules: DataFrame, model: DataFrame, entered: DataFrame, weak: list[str]) -> DataFrame:
    """Rule values, with the model's where the rule found nothing or only a weak tier, if the model's tier has entered.

    All by (doc_id, field); ``entered`` is a table of model tiers that may enter.
    """
    m = model.join(entered.select(F.col("tier")).distinct(), "tier", "left_semi").select("doc_id", "field", F.col("value").alias("m_value"), F.col("tier").alias("m_tier"))
    both = rules.join(m, ["doc_id", "field"], "full_outer")
    use = F.col("m_value").isNotNull() & (F.col("value").isNull() | F.col("tier").isin(weak))
    return both.select("doc_id", "field", F.when(use, F.col("m_value")).otherwise(F.col("value")).alias("value"), F.when(use, F.col("m_tier")).otherwise(F.col("tier")).alias("tier"), F.when(use, "model").otherwise("rule").alias("source"))


def entered_tiers(measured: DataFrame, least: int = 20, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """Tiers with enough units and precision: (tier, k, n)."""
    return measured.groupBy("tier").agg(F.count_if("correct").alias("k"), F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("k") * share[1] >= F.col("n") * share[0]))


def near_marks(scores: DataFrame, doc: str, p: str, margin: float = 0.05, floor: float = 0.5) -> DataFrame:
    """(doc, near): the best option is close to the floor or to the runner-up."""
    best = scores.groupBy(doc).agg(F.slice(F.sort_array(F.collect_list(p), asc=False), 1, 2).alias("t"))
    gap = F.get("t", F.lit(0)) - F.coalesce(F.get("t", F.lit(1)), F.lit(0.0))
    return best.select(doc, ((F.abs(F.get("t", F.lit(0)) - floor) < margin) | (gap < margin)).alias("near"))


def status(p: Column) -> Column:
    """certain from 0.9, unsure from 0.5, else none."""
    return F.when(p >= 0.9, "certain").when(p >= 0.5, "unsure").otherwise("none")


def searched_slots(documents: DataFrame, cascade: DataFrame) -> DataFrame:
    """Documents with the slots that their kind and type let be searched: (doc_id, slot, rule_id).

    ``cascade``: kind, type ('*' for any), slot, rule_id; a rule for a type goes before one for any.
    """
    fit = documents.join(cascade.withColumnsRenamed({"kind": "_kind", "type": "_type"}), (F.col("kind") == F.col("_kind")) & (F.col("_type").isin("*") | (F.col("type") == F.col("_type"))))
    best = F.min_by("rule_id", F.when(F.col("_type") == "*", 1).otherwise(0))
    return fit.groupBy("doc_id", "slot").agg(best.alias("rule_id"))


register_mark("at", ("@",))
register_mark("plus", ("+",))
register_tiers("contact", [
    Tier("e_mail", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", needs=("at",)),
    Tier("phone", r"(\+\d(?:[ .()-]{0,2}\d){7,14})", needs=("plus",)),
])
