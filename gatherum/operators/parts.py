"""Parts of documents: lines of cells, types within a family of authors, the rule chain of a document, segmentations, places of class words, gaps."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherum.functions import text as T
from gatherum.operators.documents import fixed_role


def _order(*keys: str, by: str):
    return Window.partitionBy(*keys).orderBy(by)


def _so_far(value: Column, *keys: str, by: str) -> Column:
    """The last value up to this row."""
    return F.last(value, ignorenulls=True).over(_order(*keys, by=by).rowsBetween(Window.unboundedPreceding, Window.currentRow))


# ---- lines of cells


def cells_to_lines(cells: DataFrame, page: str, pos: str, text: str, left: str, top: str, bottom: str) -> DataFrame:
    """(page, line, text, first): cells in their order joined to lines, blank ones left out.

    A cell goes on the line of the one before if they share half the height of the lower one at least and it doesn't begin further to the left.
    """
    solid = cells.where(T.present(F.col(text))).withColumn("_t", F.trim(text))
    w = _order(page, by=pos)
    before = lambda c: F.lag(c).over(w)
    shared = F.least(F.col(bottom), before(bottom)) - F.greatest(F.col(top), before(top))
    height = F.least(F.col(bottom) - F.col(top), before(bottom) - before(top))
    joins = (height > 0) & (shared * 2 >= height) & (F.col(left) >= before(left))
    numbered = solid.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("line", (F.sum("_new").over(w) - 1).cast("int"))
    in_order = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_t").alias("t"))))
    return numbered.groupBy(page, "line").agg(F.array_join(F.transform(in_order, lambda x: x["t"]), " ").alias("text"), F.min(pos).alias("first"))


# ---- gaps


def nearest_gaps(ref: DataFrame, got: DataFrame, doc: str, at: str) -> DataFrame:
    """(doc, ref, got, offset): each gap of the reference with a free gap of the method, exact ones first, else the nearest, of equally near ones the first.

    A gap is used once. Extra gaps of the method have a null ``ref``, missed ones a null ``got``. A group is the gaps of one document.
    """
    both = ref.select(doc, F.col(at).cast("long").alias("_at"), F.lit(True).alias("_is_ref")).unionByName(got.select(doc, F.col(at).cast("long").alias("_at"), F.lit(False).alias("_is_ref")))
    both = both.where("_at is not null").distinct()

    def matched(wanted: list[int], free: list[int]) -> list[tuple[int | None, int | None]]:
        known = set(wanted)
        pairs = {x: x for x in free if x in known}
        free = [x for x in free if x not in known]
        for x in wanted:
            if x not in pairs and free:
                k = bisect_left(free, x)
                k -= k == len(free) or (k > 0 and x - free[k - 1] <= free[k] - x)
                pairs[x] = free.pop(k)
        return [(x, pairs.get(x)) for x in wanted] + [(None, g) for g in free]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that are sorted by document and place; what is held is a batch and the gaps of one document."""
        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field(0).type
        rows = (row for batch in chain([first], batches) for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.int64()))], names=[doc, "ref", "got", "offset"])

        for name, gaps in groupby(rows, key=lambda r: r[0]):
            sides: tuple[list[int], list[int]] = ([], [])
            for _, place, is_ref in gaps:
                sides[not is_ref].append(place)
            out += [(name, x, y, None if x is None or y is None else y - x) for x, y in matched(*sides)]
            if len(out) > 10_000:
                yield made()
        if out:
            yield made()

    ordered = both.repartition(doc).sortWithinPartitions(doc, "_at")
    return ordered.mapInArrow(run, f"{doc} {ref.schema[doc].dataType.simpleString()}, ref long, got long, offset long")


# ---- types within a family of authors

# Words of headings and formulas in three languages.
REASONING_LABEL = r"(?iu)^\s*(?:(?:\d{1,2}\.)*\d{1,2}\.?\s+)?(?:(?:kurze?|schriftliche|m[üu]ndliche)\s+)?(?:begr[üu]ndung|gr[üu]nde|d[ée]veloppement|motivation|motivazione|exposé des motifs)\b"
SUBMITTED_LABEL = r"(?iu)^\s*(?:(?:\d{1,2}\.)*\d{1,2}\.?\s+)?(?:antr[aä]ge?|fragen?|auftrag|begehren|forderung(?:en)?|text der motion|eingereichter text|texte d[ée]pos[ée]|questions?|demande|domand[ae]|testo depositato)\b"
REQUEST = r"(?iu)(?:wird|werden|ist)\s+(?:hiermit\s+)?(?:beauftragt|aufgefordert|eingeladen|gebeten)|wir (?:fordern|bitten|ersuchen)|folgende fragen|est (?:pri[ée]|charg[ée]|invit[ée])|nous demandons|[èe] (?:invitato|incaricato)|chiediamo"
PROPOSAL_LABEL = r"(?iu)^\s*(?:antr[aä]ge?(?: des (?:stadt|regierungs|gemeinde)rat(?:e?s)?)?|propositions?|propost[ae]|pr[ée]avis|empfehlung)(?=\s*:|\s*$|\t)"
WEAK_LABEL = r"(?iu)^\s*(?:conclusions?|fazit|schlussfolgerung(?:en)?|conclusion[ei])\s*:?\s*$"
CONTINUES = r"(?u)^\s*(?:\p{Ll}|(?i:beschliessen|beschluss|d[ée]cide))"
FORMAL_PROPOSAL = r"(?iu)(?:der|dem|die) (?:\p{L}*rat|regierung|standeskommission)\s+(?:\p{L}+\s+){0,3}?(?:beantragt|wird beantragt)|beantragt (?:der|die) (?:\p{L}*rat|regierung)|stellt (?:\p{L}+\s+){0,3}?(?:den )?antrag|pr[ée]avise (?:d[ée])?favorablement|le conseil (?:municipal|d.[ée]tat|communal) (?:vous )?(?:propose|invite)|il consiglio di stato (?:propone|invita)"
NO_PROPOSAL = r"(?iu)aus (?:nach|fol)\w*(?: \w+)? gr[üu]nden|pour les raisons"
RESOLUTION = r"(?iu)\bbeschluss\b|beschliesst|beschlossen|kenntnisnahme|nimmt kenntnis|prend acte|prende atto"
SPEAKER = r"(?u)^\s*(?:\p{Lu}{2,}(?:[ -]\p{Lu}[\p{L}.]*){0,3}\.?\s+[-–]|\p{Lu}\p{L}+(?:[ -]\p{Lu}\p{L}+){0,2},?\s+\(?\p{Lu}{2,5}\)?\s*:|Referent(?:in)?\b)"
SHORT_TITLE = r"(?iu)^\s*(?:kurztitel|titre court|titolo breve)\b"


def _heading_depth(text: Column) -> Column:
    """How deep the number of a heading is: 1 for "3.", 2 for "3.1"; null without one."""
    number = F.regexp_extract(text, r"^\s*((?:\d{1,2}\.)*\d{1,2})\.?\s", 1)
    return F.when(number != "", F.size(F.split(number, r"\.")))


def _one_or_two_sentences(text: Column) -> Column:
    return F.size(T.sentences(text)) <= 2


def types_in_family(paragraphs: DataFrame, doc: str, pos: str, family: str, text: str, heading: str) -> DataFrame:
    """Adds ``type`` and ``rule``: what a paragraph is within the run of its family's paragraphs.

    SPONSOR: submitted, or reasoning from a label of reasons on until a label, a request or a heading of the same depth; headings right before a label
    of reasons belong to it. EXECUTIVE: response; recommendation from a label of a proposal to the next heading that doesn't go on with it, and
    paragraphs that are a formal proposal. PLENARY: vote, or speech from a speaker to the next resolution. TITLE: title or short_title. Other
    families have no types. Each rule is an event of a row, and the state is the last event: windows over the runs of a document, no loops.
    """
    t = F.col(text)
    fresh = F.when(F.lag(family).over(_order(doc, by=pos)).eqNullSafe(F.col(family)) & (F.row_number().over(_order(doc, by=pos)) > 1), 0).otherwise(1)
    rows = paragraphs.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(_order(doc, by=pos)))
    key, w = [doc, "_run"], _order(doc, "_run", by=pos)
    is_head = F.col(heading) | (F.length(t) <= 60)
    # Events of sponsors.
    reasons = t.rlike(REASONING_LABEL) & is_head
    rows = rows.withColumns({"_reasons": reasons, "_depth": F.when(reasons, F.coalesce(_heading_depth(t), F.lit(0)))})
    depth = _so_far(F.col("_depth"), *key, by=pos)
    same_depth = F.col(heading) & (depth > 0) & (_heading_depth(t) == depth)
    sponsor = F.when(F.col("_reasons"), F.struct(F.lit("reasoning").alias("type"), F.lit("label").alias("rule"))).when(t.rlike(SUBMITTED_LABEL) & is_head, F.struct(F.lit("submitted").alias("type"), F.lit("submitted_label").alias("rule")))
    sponsor = sponsor.when(t.rlike(REQUEST), F.struct(F.lit("submitted").alias("type"), F.lit("request").alias("rule"))).when(same_depth, F.struct(F.lit("submitted").alias("type"), F.lit("same_depth").alias("rule")))
    # Events of the executive.
    formal = t.rlike(FORMAL_PROPOSAL) & ~t.rlike(NO_PROPOSAL)
    label = t.rlike(PROPOSAL_LABEL) & is_head
    inline = t.rlike(PROPOSAL_LABEL) & t.rlike(r"(?u)^[^:\t]{1,60}[:\t]\s*\S")
    weak = t.rlike(WEAK_LABEL)
    next_formal = F.coalesce(F.lead(formal).over(w), F.lit(False))
    pair = lambda kind, rule: F.struct(F.lit(kind).alias("type"), F.lit(rule).alias("rule"))
    executive = (
        F.when(label & ~inline, pair("recommendation", "label"))
        .when(weak & next_formal, pair("recommendation", "weak_label"))
        .when(weak, pair("response", "weak_label_alone"))
        .when(F.col(heading) & ~t.rlike(CONTINUES) & ~inline, pair("response", "heading"))
        .when(formal & _one_or_two_sentences(t) & F.rtrim(t).endswith(":"), pair("recommendation", "proposal_list"))
    )
    # Events of the plenary.
    plenary = F.when(t.rlike(RESOLUTION), pair("vote", "resolution")).when(t.rlike(SPEAKER), pair("speech", "speaker"))
    event = F.when(F.col(family) == "SPONSOR", sponsor).when(F.col(family) == "EXECUTIVE", executive).when(F.col(family) == "PLENARY", plenary)
    rows = rows.withColumns({"_event": event, "_inline": inline, "_formal": formal & _one_or_two_sentences(t)})
    default = F.when(F.col(family) == "SPONSOR", "submitted").when(F.col(family) == "EXECUTIVE", "response").when(F.col(family) == "PLENARY", "vote")
    rows = rows.withColumn("_state", F.coalesce(_so_far(F.col("_event.type"), *key, by=pos), default))
    # Headings right before a label of reasons, or before a speaker, go with it: the first row behind that is no plain heading decides.
    plain = F.col(heading) & (F.col("_event").isNull() | (F.col("_event.rule") == "heading"))
    ahead = F.first(F.when(~plain, F.struct(F.coalesce(F.col("_event.rule"), F.lit("")).alias("rule"))), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))["rule"]
    moved = F.when(plain & (F.col(family) == "SPONSOR") & (ahead == "label") & (F.col("_state") == "submitted"), pair("reasoning", "heading_before")).when(plain & (F.col(family) == "PLENARY") & (ahead == "speaker"), pair("speech", "heading_before"))
    own = F.when((F.col(family) == "EXECUTIVE") & F.col("_inline"), pair("recommendation", "inline_label")).when((F.col(family) == "EXECUTIVE") & F.col("_formal") & (F.col("_state") == "response"), pair("recommendation", "proposal"))
    title = F.when(F.col(family) == "TITLE", F.when(t.rlike(SHORT_TITLE), pair("short_title", "label")).otherwise(pair("title", "default")))
    carried = F.when(F.col("_state").isNotNull(), F.struct(F.col("_state").alias("type"), F.coalesce(F.col("_event.rule"), F.when(F.col("_state") == default, "default").otherwise("continues")).alias("rule")))
    chosen = F.coalesce(title, moved, own, carried)
    rows = rows.withColumn("_chosen", chosen)
    return rows.select(*paragraphs.columns, F.col("_chosen.type").alias("type"), F.col("_chosen.rule").alias("rule"))


# ---- the rule chain of a document

#: Families that a document of a role may have, and the one that its text begins with behind the title.
CHAINS = {"proposal": ("SPONSOR",), "response": ("EXECUTIVE",), "combined": ("SPONSOR", "EXECUTIVE"), "minutes": ("PLENARY",), "other": ()}
_FAMILY_MARKS = [
    ("EXECUTIVE", r"(?iu)^\s*(?:antwort|beantwortung|stellungnahme|r[ée]ponse|risposta)\b"),
    ("SPONSOR", r"(?iu)^\s*(?:motion|postulat|interpellation|anfrage|mozione|interpellanza|eingereicht von|d[ée]pos[ée]e? par)\b"),
    ("PLENARY", r"(?iu)^\s*(?:beratung|verhandlung|d[ée]bat|discussione|protokoll)\b"),
]


def rule_chain(lines: DataFrame, doc: str, pos: str, text: str, label: str, role: str) -> DataFrame:
    """(doc, pos, answer): the answer of each line from the rules of its document's role, one rule after the other.

    Lines with a fixed role are furniture (pictures none). The first lines up to the first mark of a family are the title; a mark starts its family if the
    document's role admits it, and the family goes on. Within a family the types are those of ``types_in_family``. A document of no known role has
    only furniture and ``text``.
    """
    t = F.col(text)
    fixed = fixed_role(t, F.col(label), F.lit(False))
    admits = F.get(F.array(F.create_map(*[x for r, fs in CHAINS.items() for x in (F.lit(r), F.array(*map(F.lit, fs)).cast("array<string>"))])), F.lit(0))[F.col(role)]
    mark = F.when(F.lit(False), F.lit(None).cast("string"))
    for family, pattern in _FAMILY_MARKS:
        mark = mark.when(t.rlike(pattern) & F.array_contains(admits, family), family)
    rows = lines.withColumns({"_fixed": fixed, "_admits": admits})
    rows = rows.withColumn("_mark", F.when(F.col("_fixed").isNull(), mark))
    family = F.when(F.size("_admits") > 0, F.coalesce(_so_far(F.col("_mark"), doc, by=pos), F.lit("TITLE")))
    rows = rows.withColumn("_family", family)
    free = rows.where("_fixed is null and _family is not null").withColumn("_head", F.col(label) == "section_header")
    typed = types_in_family(free, doc, pos, "_family", text, "_head").select(doc, pos, F.concat_ws("/", F.lower("_family"), "type").alias("answer"))
    rest = rows.where("_fixed is not null or _family is null").select(doc, pos, F.when(F.col("_fixed").isin("R1", "R4", "R5"), "furniture").when(F.col("_fixed") == "R3", "none").when(F.col("_fixed") == "R2", "footnote").otherwise("text").alias("answer"))
    return typed.unionByName(rest)


# ---- forms of documents

_RESPONSE_WORDS = r"(?iu)\b(?:der|die) (?:\p{L}*rat|regierung) (?:antwortet|nimmt .{0,40}stellung|beantwortet)|le conseil .{0,30}r[ée]pond|r[ée]ponse du conseil|risposta del (?:consiglio|municipio)"
_GREETING = r"(?iu)^\s*(?:sehr geehrte|monsieur|madame|mesdames|egregi|gentil)"
_DECISION_WORDS = r"(?iu)\b(?:der|das) (?:\p{L}*rat|parlament) (?:hat )?(?:beschliesst|beschlossen|nimmt kenntnis)|le grand conseil d[ée]cr[èe]te|il gran consiglio (?:decreta|decide)"
_PROPOSAL_WORDS = r"(?iu)\b(?:eingereicht von|unterzeichnende|erstunterzeichner|d[ée]pos[ée]e? par|soussign|presentat[oa] da|firmatari)"


def form_predicates(lines: DataFrame, doc: str, pos: str, text: str, head: int = 25) -> DataFrame:
    """(doc, executive, letter, decision, proposal): what the lines of a document say of its form; a letter greets within its first lines."""
    t = F.col(text)
    any_line = lambda pattern: F.coalesce(F.bool_or(t.rlike(pattern)), F.lit(False))
    return lines.groupBy(doc).agg(any_line(_RESPONSE_WORDS).alias("executive"), F.coalesce(F.bool_or((F.col(pos) < head) & t.rlike(_GREETING)), F.lit(False)).alias("letter"), any_line(_DECISION_WORDS).alias("decision"), any_line(_PROPOSAL_WORDS).alias("proposal"))


# ---- segmentations


def segmentation_errors(segments: DataFrame, main: DataFrame, doc: str, classes: list[str]) -> DataFrame:
    """(doc, segment, error): what makes a segmentation invalid.

    ``segments``: doc, segment (from 0), class, first, last (positions among the main lines); ``main``: doc, n (number of main lines). Segments cover the main
    lines in order without gap or overlap, have known classes, and neighbours differ in class.
    """
    w = _order(doc, by="segment")
    rows = segments.join(main.select(doc, "n"), doc).withColumns({"_before": F.lag("last").over(w), "_class": F.lag("class").over(w), "_is_last": F.lead("segment").over(w).isNull()})
    outside = (F.col("first") < 0) | (F.col("last") >= F.col("n")) | F.col("first").isNull() | F.col("last").isNull()
    checks = [
        ("unknown_class", ~F.coalesce(F.col("class").isin(*classes), F.lit(False))), ("outside", outside), ("wrong_start", ~outside & (F.col("first") != F.coalesce(F.col("_before") + 1, F.lit(0)))),
        ("backwards", ~outside & (F.col("last") < F.col("first"))), ("lines_left", ~outside & F.col("_is_last") & (F.col("last") < F.col("n") - 1)), ("same_class", F.coalesce(F.col("class") == F.col("_class"), F.lit(False))),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks]), lambda x: x.isNotNull())
    return rows.select(doc, "segment", F.explode(found).alias("error"))


def compare_segmentations(lines: DataFrame, doc: str, pos: str, ref: str, hyp: str) -> DataFrame:
    """(doc, tp, n_ref, n_hyp, content, omitted, exact) of segment numbers on the lines that the reference doesn't call furniture.

    A null segment is furniture. Lines that only the method calls furniture are omitted ones; they go with the segment before.
    """
    w = _order(doc, by=pos)
    rows = lines.where(F.col(ref).isNotNull()).withColumn("_h", F.last(hyp, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    begins = lambda c: F.when(F.row_number().over(w) > 1, ~F.col(c).eqNullSafe(F.lag(c).over(w))).otherwise(F.lit(False))
    rows = rows.withColumns({"_br": begins(ref), "_bh": begins("_h")})
    out = rows.groupBy(doc).agg(F.count_if(F.col("_br") & F.col("_bh")).alias("tp"), F.count_if("_br").alias("n_ref"), F.count_if("_bh").alias("n_hyp"), F.count("*").alias("content"), F.count_if(F.col(hyp).isNull()).alias("omitted"))
    return out.withColumn("exact", (F.col("tp") == F.col("n_ref")) & (F.col("tp") == F.col("n_hyp")) & (F.col("omitted") == 0))


def segmentation_summary(compared: DataFrame) -> DataFrame:
    """One row: documents, precision, recall, f1, omission_rate, exact_rate, from sums over documents; 1 where there is nothing to find."""
    share = lambda a, b, empty: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(empty))
    sums = compared.agg(F.count("*").alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "n_ref", "n_hyp", "content", "omitted")], F.count_if("exact").alias("exact"))
    rated = sums.withColumns({"precision": share("tp", "n_hyp", 1.0), "recall": share("tp", "n_ref", 1.0), "omission_rate": share("omitted", "content", 0.0), "exact_rate": share("exact", "documents", 0.0)})
    both = F.col("precision") + F.col("recall")
    return rated.select("documents", "precision", "recall", F.when(both > 0, F.col("precision") * F.col("recall") * 2 / both).otherwise(0.0).alias("f1"), "omission_rate", "exact_rate")


# ---- the place of a class


def class_places(lines: DataFrame, doc: str, pos: str, text: str, wanted: DataFrame, words: dict[str, str], head_words: dict[str, str], terms: dict[str, str], head: int = 15, short: int = 8) -> DataFrame:
    """(doc, class, pass, line, start, word): the first word of a document's class, in three passes.

    ``wanted``: doc, class. Pass 1 looks for ``words`` (class to pattern) at the start of any line, pass 2 for ``head_words`` anywhere in short lines of the head, pass 3 for
    ``terms`` there too; a later pass counts only where those before find nothing. Documents in which all find nothing give no row.
    """
    joined = lines.join(wanted.select(doc, "class"), doc)
    is_short = (F.col(pos) < head) & (F.size(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))) <= short)
    found = []
    for number, (table, admitted, before) in enumerate(((words, F.lit(True), r"^\s*"), (head_words, is_short, r"(?<!\p{L})"), (terms, is_short, r"(?<!\p{L})")), 1):
        hit = F.lit(None).cast("string")
        for name, pattern in table.items():
            hit = F.when((F.col("class") == name) & admitted, F.nullif(F.regexp_extract(text, f"(?iu){before}({pattern})", 1), F.lit(""))).otherwise(hit)
        found.append(F.when(hit.isNotNull(), F.struct(F.lit(number).alias("pass"), F.col(pos).alias("line"), (F.instr(F.col(text), hit) - 1).cast("int").alias("start"), hit.alias("word"))))
    best = F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return joined.withColumn("_best", best).where("_best is not null").groupBy(doc, "class").agg(F.min("_best").alias("b")).select(doc, "class", "b.*")
