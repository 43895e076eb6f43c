"""Records of documents: answers of lines, evidence, references of registers, nested records, views and their checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherum.operators import sequence as Q


def odd_mark(items: DataFrame, group: list[str], mark: str) -> DataFrame:
    """Items of a list whose mark only they have, in lists of three or more where all others share one mark."""
    counted = items.groupBy(*group, mark).agg(F.count("*").alias("_n"))
    shape = counted.groupBy(*group).agg(F.count("*").alias("_marks"), F.sum("_n").alias("_all"))
    odd = counted.where("_n = 1").join(shape.where("_marks = 2 and _all >= 3"), group)
    return items.join(odd.select(*group, mark), [*group, mark], "left_semi")


def composed_answers(lines: DataFrame, fixed: str, family: str, out: str = "answer") -> DataFrame:
    """An answer per line: fixed roles first (R1, R4, R5: furniture; R3: none), then the family, filled forward in its document."""
    base = F.when(F.col(fixed).isin("R1", "R4", "R5"), "furniture").when(F.col(fixed) == "R3", "none")
    filled = F.last(family, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line"))
    return lines.withColumn(out, F.coalesce(base, filled, F.lit("other")))


def unit_violations(units: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, unit, reason) of units (first, last line) that are empty, leave their document, or overlap the one before."""
    size = lines.groupBy("doc_id").agg(F.max("line").alias("_max"))
    before = F.max("last").over(Window.partitionBy("doc_id").orderBy("first", "unit").rowsBetween(Window.unboundedPreceding, -1))
    checked = units.withColumn("_before", before).join(size, "doc_id", "left")
    reason = F.when(F.col("_max").isNull(), "no_document").when(F.col("first") > F.col("last"), "empty").when((F.col("first") < 0) | (F.col("last") > F.col("_max")), "outside").when(F.col("first") <= F.col("_before"), "overlap")
    return checked.withColumn("reason", reason).where("reason is not null").select("doc_id", "unit", "reason")


def units_to_lines(units: DataFrame) -> DataFrame:
    """(doc_id, line, unit): segments as one answer per line."""
    return units.select("doc_id", F.explode(F.sequence("first", "last")).alias("line"), "unit")


def lines_to_units(lines: DataFrame, answer: str) -> DataFrame:
    """Segments (first, last) of equal answers."""
    return Q.runs(lines, "doc_id", "line", answer).select("doc_id", F.col("run").alias("unit"), answer, "first", "last")


def form_predicates(lines: DataFrame, forms: dict[str, str], head: int = 15) -> DataFrame:
    """One Boolean per form: some head line of the document says so."""
    return lines.groupBy("doc_id").agg(*[F.coalesce(F.bool_or((F.col("line") < head) & F.col("text").rlike(p)), F.lit(False)).alias(name) for name, p in forms.items()])


def kind_decision(role: Column, has_answer: Column, has_demand: Column) -> Column:
    """Kind of a document for the choice of labels: combined, response, proposal or other."""
    return F.when(has_answer & has_demand, "combined").when(has_answer | (role == "response"), "response").when(has_demand | (role == "proposal"), "proposal").otherwise("other")


def reference_set(events: DataFrame, key: str, value: str, primary: str) -> DataFrame:
    """(key, values, reason, primary_set): distinct values of a key's primary events, else of all; why there are none."""
    g = events.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col(primary), F.col(value)))).alias("_p"), F.array_sort(F.collect_set(value)).alias("_a"))
    use = F.size("_p") > 0
    values = F.when(use, F.col("_p")).otherwise(F.col("_a"))
    return g.select(key, values.alias("values"), F.when(F.size(values) == 0, "empty").alias("reason"), use.alias("primary_set"))


def weak_labels(blocks: DataFrame, references: DataFrame, doc: str, text: str, value: str) -> DataFrame:
    """Blocks that hold a reference value of their document (in any case)."""
    return blocks.join(references.select(doc, F.col(value).alias("_v")).where("_v <> ''"), doc).where(F.contains(F.lower(text), F.lower("_v"))).drop("_v").distinct()


def nested_view(documents: DataFrame, blocks: DataFrame, doc: str, order: str, fields: list[str]) -> DataFrame:
    """(doc, view): each document with its blocks in order, as JSON."""
    kept = blocks.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(order), *fields))).alias("blocks"))
    return documents.join(kept, doc, "left").select(doc, F.to_json(F.struct(*[c for c in documents.columns], "blocks")).alias("view"))


def broken_links(links: DataFrame, targets: DataFrame, source: str, target: str, key: str) -> DataFrame:
    """Links whose target isn't there."""
    return links.join(targets.select(F.col(key).alias(target)).distinct(), target, "left_anti").select(source, target)


def leaves(records: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value): scalar fields of JSON objects, one level of nesting."""
    top = records.select(key, F.explode(F.from_json(json, "map<string,string>")).alias("path", "value"))
    nested = top.where(F.col("value").startswith("{")).select(key, "path", F.explode(F.from_json("value", "map<string,string>")).alias("p2", "v2"))
    flat = top.where(~F.coalesce(F.col("value").startswith("{"), F.lit(False)))
    return flat.unionByName(nested.select(key, F.concat_ws(".", "path", "p2").alias("path"), F.col("v2").alias("value")))


def line_markers(text: Column, rules: dict[str, str]) -> Column:
    """Names of the markers that a line has, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in rules.items()]))


def rich_text(text: Column) -> Column:
    """Plain lines as HTML: escaped, addresses as links, list items as items, other lines as paragraphs."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    linked = F.regexp_replace(safe, r"(https?://[^\s<]+)", "<a href=\"$1\">$1</a>")
    item = F.regexp_replace(linked, r"(?m)^\s*[-•–]\s+(.*)$", "<li>$1</li>")
    return F.regexp_replace(item, r"(?m)^(?!<li>)(.*\S.*)$", "<p>$1</p>")


def design_allocation(sizes: dict[str, int], total: int, share: float = 0.5) -> dict[str, int]:
    """Places by square root of size, one at least, capped at a share of the stratum (strata of one row get none).

    Water is poured over the roots until it stands at the caps of the full strata; what is left after rounding down goes to
    the largest fractions, and what rounding up to one has cost comes from the strata with the least water.
    """
    names = sorted(sizes)
    size = np.array([sizes[s] for s in names], dtype=float)
    cap = np.where(size > 1, np.ceil(share * size), 0)
    total, root = min(total, int(cap.sum())), np.sqrt(size)
    full = cap == 0
    while not full.all():
        level = np.where(full, 0.0, (total - cap[full].sum()) * root / root[~full].sum())
        spills = ~full & (level >= cap)
        if not spills.any():
            break
        full |= spills
    if full.all():
        return dict(zip(names, cap.astype(int).tolist()))
    places = np.where(full, cap, np.maximum(1, np.floor(level))).astype(int)
    left = total - int(places.sum())
    order = np.argsort(np.floor(level) - level if left > 0 else level, kind="stable")
    able = [i for i in order if not full[i] and (places[i] < cap[i] if left > 0 else places[i] > 0)]
    for i in able[: abs(left)]:
        places[i] += 1 if left > 0 else -1
    return dict(zip(names, places.tolist()))


def round_robin_groups(groups: DataFrame, group: str, stratum: str, n: int, seed: str) -> DataFrame:
    """The first n whole groups, dealt from strata in turn, in hash order inside each stratum."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(group)).cast("binary"), 256)
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(order, group))
    return groups.select(group, stratum).distinct().withColumn("turn", turn).orderBy("turn", stratum).limit(n)


def record_gaps(rows: DataFrame, item: str, of_register: list[str], of_document: list[str]) -> DataFrame:
    """(item, kind, gaps, problems): slots without a value. An item none of whose register slots has a value has no entry there, and those are recorded gaps; all others missing are problems."""
    missing = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    no_entry = F.lit(True)
    for c in of_register:
        no_entry = no_entry & missing(c)
    gaps = F.array_compact(F.array(*[F.when(missing(c), F.lit(c)) for c in (*of_register, *of_document)]))
    counted = sum([F.when(missing(c), 1).otherwise(0) for c in of_document], F.lit(0)) + sum([F.when(missing(c) & ~no_entry, 1).otherwise(0) for c in of_register], F.lit(0))
    return rows.select(item, F.when(no_entry, "document_only").otherwise("register").alias("kind"), gaps.alias("gaps"), counted.cast("long").alias("problems"))


def read_choice(answer: Column, choices: list[str]) -> Column:
    """(choice, state) of a model's answer to a question with few choices: exact, json, loose (one choice is named), ambiguous, unreadable or empty."""
    solid = F.regexp_replace(F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?m)^```\w*[ \t]*$", ""), r"^\s+|\s+$", "")
    stated = F.upper(F.get_json_object(F.when(solid.startswith("{"), solid), "$.choice"))
    listed = "|".join(choices)
    named = F.array_distinct(F.transform(F.regexp_extract_all(solid, F.lit(rf"(?:^|(?<=[\s(\"']))({listed}|{listed.lower()})(?=[\s).,:;\"']|$)"), F.lit(1)), F.upper))
    pair = lambda choice, state: F.struct(choice.cast("string").alias("choice"), F.lit(state).alias("state"))
    return (
        F.when(solid == "", pair(F.lit(None), "empty")).when(solid.isin(*choices), pair(solid, "exact")).when(stated.isin(*choices), pair(stated, "json"))
        .when(F.size(named) == 1, pair(F.get(named, F.lit(0)), "loose")).when(F.size(named) > 1, pair(F.lit(None), "ambiguous")).otherwise(pair(F.lit(None), "unreadable"))
    )
