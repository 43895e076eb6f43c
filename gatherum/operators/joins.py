"""Joins by place and nearness: intervals, nearest days, boxes, repeated lines, one-to-one matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherum.functions import text as T


def interval_lookup(points: DataFrame, spans: DataFrame, doc: str, at: str, start: str = "start", stop: str = "stop", bucket: int = 4096) -> DataFrame:
    """Each point with the span of its document that holds it (start <= at < stop).

    Both sides carry the number of their stretch of ``bucket`` characters as a second key, so one huge document spreads over
    many keys and the join stays an equi-join.
    """
    cut = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.greatest(F.col(stop), F.col(start) + 1) - 1) / bucket))))
    return points.withColumn("_cell", F.floor(F.col(at) / bucket)).join(cut, [doc, "_cell"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(stop))).drop("_cell")


def interval_overlap(a: DataFrame, b: DataFrame, doc: str, a_span: tuple[str, str], b_span: tuple[str, str], bucket: int = 4096) -> DataFrame:
    """Pairs of overlapping spans of a document, each once: it counts in the cell where the later of the two starts lies."""
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / bucket)))
    left, right = a.withColumn("_cell", cells(*a_span)), b.withColumn("_cell", cells(*b_span))
    hit = (F.col(a_span[0]) < F.col(b_span[1])) & (F.col(a_span[1]) > F.col(b_span[0]))
    once = F.floor(F.greatest(F.col(a_span[0]), F.col(b_span[0])) / bucket) == F.col("_cell")
    return left.join(right, [doc, "_cell"]).where(hit & once).drop("_cell")


def nearest_day(events: DataFrame, candidates: DataFrame, key: str, event_id: str, day: str, candidate_id: str, candidate_day: str, close: int = 7) -> DataFrame:
    """For each event the candidate of the same key: those at most ``close`` days after first, then the nearest, then the smallest id.

    Only the last candidate up to an event's day and the first one behind it can be that: both are windows over the days of a key, with one row for all candidates of
    a day, so a busy key costs a sort and not the product of its rows. Rows without a day take no part; events of a key without candidates give no row.
    """
    days = candidates.where(F.col(candidate_day).isNotNull()).groupBy(key, F.col(candidate_day).alias("_day")).agg(F.min(candidate_id).alias("_id"))
    marks = days.select(key, "_day", F.struct("_day", "_id").alias("_mark"), F.lit(None).cast(events.schema[event_id].dataType).alias("_event"))
    asked = events.where(F.col(day).isNotNull()).select(key, F.col(day).alias("_day"), F.lit(None).cast(marks.schema["_mark"].dataType).alias("_mark"), F.col(event_id).alias("_event"), F.lit(True).alias("_asks"))
    w = Window.partitionBy(key).orderBy("_day", F.col("_asks").asc_nulls_first())
    both = marks.withColumn("_asks", F.lit(None).cast("boolean")).unionByName(asked)
    placed = both.withColumns({"_back": F.last("_mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_ahead": F.first("_mark", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))}).where("_asks")

    def order(mark: Column) -> Column:
        diff = F.date_diff(mark["_day"], F.col("_day"))
        return F.when(mark.isNotNull(), F.struct(F.when(diff <= close, 0).otherwise(1).alias("class"), F.abs(diff).alias("abs"), mark["_id"].alias("id"), diff.alias("diff")))

    best = placed.select(key, F.col("_event").alias(event_id), F.least(order(F.col("_back")), order(F.col("_ahead"))).alias("b")).where("b is not null")
    return best.groupBy(key, event_id).agg(F.min("b").alias("b")).select(key, event_id, F.col("b.id").alias(candidate_id), F.col("b.diff").alias("days"))


def zip_mismatches(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Places where two aligned tables differ: a side is missing, or the values are unequal."""
    x, y = a.select(*keys, F.col(value).alias("left_value")), b.select(*keys, F.col(value).alias("right_value"))
    return x.join(y, keys, "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def repeated_lines(lines: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Lines whose letters stand on another page of the document too (page numbers left out): (doc, page, text).

    Exact form; the number of pages is counted per key instead of pairing lines.
    """
    letters, _ = T.furniture_key(F.col(text))
    keyed = lines.withColumn("_letters", letters).where("_letters <> ''")
    often = keyed.groupBy(doc, "_letters").agg(F.min(page).alias("_a"), F.max(page).alias("_b")).where("_a < _b").select(doc, "_letters")
    return keyed.join(often, [doc, "_letters"], "left_semi").drop("_letters")


#: Distinct texts of a group up to which each is compared with each.
_PAIRED = 1000


def similar_texts(texts: DataFrame, group: list[str], text: str, least: float = 0.9, q: int = 2, paired: int = _PAIRED) -> DataFrame:
    """Pairs (group, text, other) of texts, each once in a group, whose ratio of matching blocks is ``least`` or more; also each text with itself.

    In groups of up to ``paired`` texts each meets each of a fitting length. What has no match costs an edit at most, so only pairs with so few edits go to Python.

    In larger groups a prefix filter over q-grams finds the candidates. With a ratio r a text of m letters and its partner have at most (1 - r) * 2 * m / r
    letters without a match, and each spoils q grams at most; so they share all but that many of their grams, and in any fixed order
    of grams they share one among the first few. Rare grams go first, so that few texts meet; repeats of a gram are numbered. Only
    candidates of a fitting length are compared, and no text meets all others of its group. Grams carry the digest of their text, not the text.
    """
    if least < 0.9 or q != 2:
        raise ValueError("the filter is sure for ratios of 0.9 and more, with grams of two letters")
    fits = lambda n, m: 2 * F.least(n, m) >= least * (n + m) - 1e-9
    base = texts.repartition(*group).select(*group, F.col(text).alias("_t"), F.length(text).alias("_n")).distinct()
    sized = base.withColumn("_many", F.count("*").over(Window.partitionBy(*group)))

    near_by = lambda a, b, n, m: fits(n, m) & (F.call_function("levenshtein", a, b, F.floor((1 - least) * (n + m) + 1e-9).cast("int")) >= 0)
    both = lambda x, y: F.array(F.struct(x["_t"].alias("a"), y["_t"].alias("b")), F.struct(y["_t"].alias("a"), x["_t"].alias("b")))
    packed = sized.where((F.col("_many") > 1) & (F.col("_many") <= paired)).groupBy(*group).agg(F.collect_list(F.struct("_t", "_n")).alias("_all"))
    behind = lambda i: F.slice("_all", i + 2, F.size("_all"))
    near = F.transform("_all", lambda x, i: F.flatten(F.transform(F.filter(behind(i), lambda y: near_by(x["_t"], y["_t"], x["_n"], y["_n"])), lambda y: both(x, y))))
    few = packed.select(*group, F.explode(F.flatten(near)).alias("_p")).select(*group, F.col("_p.a").alias(text), F.col("_p.b").alias("other"))

    many = sized.where(F.col("_many") > paired).select(*group, "_t", "_n", F.unhex(F.md5(F.col("_t").cast("binary"))).alias("_id"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_n") - q + 1, F.lit(1))), lambda i: F.substr(F.col("_t"), i, F.lit(q)))
    each = many.select(*group, "_id", "_n", F.explode(grams).alias("_gram")).groupBy(*group, "_id", "_n", "_gram").agg(F.count("*").alias("_c"))
    numbered = each.select(*group, "_id", "_n", F.explode(F.transform(F.sequence(F.lit(1), "_c"), lambda k: F.concat_ws("#", "_gram", k.cast("string")))).alias("_gram"))
    ranked = numbered.join(numbered.groupBy("_gram").agg(F.count("*").alias("_often")), "_gram").withColumn("_at", F.row_number().over(Window.partitionBy(*group, "_id").orderBy("_often", "_gram")))
    spoilt = q * F.floor((1 - least) * 2 / least * F.col("_n") + 1e-9)
    first = ranked.where(F.col("_at") <= spoilt + 1).select(*group, "_id", "_n", "_gram")
    other = first.select(*group, "_gram", F.col("_id").alias("_other"), F.col("_n").alias("_m"))
    met = first.join(other, [*group, "_gram"]).where(fits(F.col("_n"), F.col("_m")) & (F.col("_id") != F.col("_other"))).select(*group, "_id", "_other").distinct()
    told = lambda id, name: many.select(*group, F.col("_id").alias(id), F.col("_t").alias(name))
    rest = met.join(told("_id", text), [*group, "_id"]).join(told("_other", "other"), [*group, "_other"]).select(*group, text, "other")
    rest = rest.where(near_by(F.col(text), F.col("other"), F.length(text), F.length("other")))
    return few.unionByName(rest).where(T.similarity(text, "other") >= least).unionByName(base.select(*group, F.col("_t").alias(text), F.col("_t").alias("other")))


def similar_lines(lines: DataFrame, doc: str, page: str, line: str, text: str, top: str, least: float = 0.9, distance: float = 30.0) -> DataFrame:
    """Lines with a similar line on another page of the document at about the same height: letters with a ratio of matching blocks of ``least``, as many digits.

    Texts are compared, not lines: each once in a document, however often it stands there. Then heights are looked up by band; of lines
    with one text and height only the first and the last page count. What is joined holds digests of the letters.
    """
    letters, digits = T.furniture_key(F.col(text))
    key = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))
    keyed = lines.withColumns({"_letters": letters, "_digits": F.length(digits), "_band": F.floor(F.col(top) / distance)}).where("_letters <> ''").withColumn("_key", key("_letters"))
    pairs = similar_texts(keyed.select(doc, "_digits", "_letters"), [doc, "_digits"], "_letters", least).select(doc, "_digits", key("_letters").alias("_key"), key("other").alias("_other"))
    places = keyed.groupBy(doc, "_digits", F.col("_key").alias("_other"), "_band", F.col(top).alias("_top")).agg(F.min(page).alias("_first"), F.max(page).alias("_last"))
    near = pairs.join(places, [doc, "_digits", "_other"]).withColumn("_band", F.explode(F.array(F.col("_band") - 1, F.col("_band"), F.col("_band") + 1)))
    a, b = keyed.alias("a"), near.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (doc, "_digits", "_key", "_band")]
    meets = (F.abs(F.col(f"a.{top}") - F.col("b._top")) <= distance) & ((F.col("b._first") != F.col(f"a.{page}")) | (F.col("b._last") != F.col(f"a.{page}")))
    return a.join(b, [*same, meets], "left_semi").select(*lines.columns)


def best_box(boxes: DataFrame, clusters: DataFrame, page: list[str], box: str, cluster_box: str, iou: Column, box_id: str, least: float = 0.5) -> DataFrame:
    """For each box the cluster of its page with the largest overlap, if that is enough."""
    pairs = boxes.join(clusters, page).withColumn("iou", iou).where(F.col("iou") >= least)
    w = Window.partitionBy(*page, box_id).orderBy(F.desc("iou"))
    return pairs.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def greedy_matches(pairs: DataFrame, group: str, left: str, right: str, score: str, least: float = 0.0, tasks: int | None = None) -> DataFrame:
    """One-to-one matches within each group: pairs by falling score (ties by left, right), each side once.

    ``pairs`` holds scored candidate pairs within documents. Rows come sorted by group and stream through one task, which
    holds the used sides of one group at a time. ``tasks``: how many tasks groups are dealt to, else as many as the session has partitions.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used_left, used_right = object(), set(), set()
        for batch in batches:
            keep = []
            for i, (g, a, b) in enumerate(zip(batch[group], batch[left], batch[right])):
                if g != now:
                    now, used_left, used_right = g, set(), set()
                if a not in used_left and b not in used_right:
                    used_left.add(a)
                    used_right.add(b)
                    keep.append(i)
            yield batch.iloc[keep]

    chosen = pairs.select(group, left, right, score).where(F.col(score) > least)
    ordered = (chosen.repartition(tasks, group) if tasks else chosen.repartition(group)).sortWithinPartitions(group, F.desc(score), left, right)
    return ordered.mapInPandas(match, chosen.schema)


#: Cells of a table that is filled in directly; larger problems are halved first.
_TABLE_CELLS = 1 << 14


def _common_counts(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of a longest common sequence of each a[:k] (k from 0) with all of b. One integer holds a bit for each word of a; a word of b costs a few operations on it."""
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    whole = (1 << len(a)) - 1
    state = whole
    for y in b:
        hit = state & places.get(y, 0)
        state = ((state + hit) | (state - hit)) & whole
    bits = np.unpackbits(np.frombuffer(state.to_bytes(-(-len(a) // 8) or 1, "little"), dtype=np.uint8), bitorder="little")[: len(a)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _filled(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i, j] = table[i + 1, j + 1] + 1 if a[i] == b[j] else max(table[i + 1, j], table[i, j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align_words(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common word sequence, in memory that grows with the number of words.

    Equal ends are cut off. Of what is left, b is halved, and a where the counts of the two halves together are largest (the second counted
    from behind); both parts are aligned alone, until a table of them is small. The time is that of all cells divided by the bits of a word.
    """
    numbers: dict[str, int] = {}
    x, y = ([numbers.setdefault(w, len(numbers)) for w in words] for words in (a, b))
    out, parts = [], [(0, len(x), 0, len(y))]
    while parts:
        i, k, j, l = parts.pop()
        while i < k and j < l and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < l and x[k - 1] == y[l - 1]:
            k, l = k - 1, l - 1
            out.append((k, l))
        if i == k or j == l:
            continue
        if (k - i) * (l - j) <= _TABLE_CELLS:
            out += [(i + p, j + q) for p, q in _filled(x[i:k], y[j:l])]
            continue
        if l - j == 1:
            out += [(p, j) for p in range(i, k) if x[p] == y[j]][:1]
            continue
        half = (j + l) // 2
        front, back = _common_counts(x[i:k], y[j:half]), _common_counts(x[i:k][::-1], y[half:l][::-1])
        cut = i + int((front + back[::-1]).argmax())
        parts += [(i, cut, j, half), (cut, k, half, l)]
    return sorted(out)


def aligned_rows(lines: DataFrame, doc: str, a: str, b: str) -> DataFrame:
    """(doc, a_word, b_word): aligned word places of two versions of each document's text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, j) for d, x, y in zip(batch[doc], batch[a], batch[b]) for i, j in align_words((x or "").split(), (y or "").split())]
            yield pd.DataFrame(rows, columns=[doc, "a_word", "b_word"])

    return lines.select(doc, a, b).mapInPandas(run, f"{doc} {lines.schema[doc].dataType.simpleString()}, a_word int, b_word int")


def key_values(lines: DataFrame, text: str) -> DataFrame:
    """Adds key and value of lines of the form "key: value" (a key has at most five words and starts with a letter)."""
    form = r"^\s*(\p{L}[\p{L}\p{N}./-]*(?: [\p{L}\p{N}./-]+){0,4})\s*:\s+(\S.*?)\s*$"
    return lines.withColumns({"key": T.blank_to_null(F.regexp_extract(text, form, 1)), "value": T.blank_to_null(F.regexp_extract(text, form, 2))})


def form_fields(cells: DataFrame, form: str, pos: str, x: str, y: str, text: str, labels: list[str], row: float = 6.0, below: float = 30.0) -> DataFrame:
    """(form, pos, key, value) of the cells that are a known label: the value stands behind a colon, else next to the right on the same row, else next below.

    Cells of one row differ in height by at most ``row``; a value below starts at the same place and no more than ``below`` further down. Joins stay within a form.
    """
    solid = cells.where(T.present(F.col(text)))
    inline = key_values(solid, text).where("key is not null")
    name = F.regexp_replace(F.trim(text), r"\s*:\s*$", "")
    known = F.lower(name).isin(*labels)
    split = inline.where(F.lower("key").isin(*labels)).select(form, pos, "key", "value")
    label = solid.where(known).select(form, F.col(pos).alias("_pos"), name.alias("key"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    other = solid.where(~known).join(split.select(form, pos), [form, pos], "left_anti").select(form, F.col(x).alias("_x2"), F.col(y).alias("_y2"), F.trim(text).alias("_text"))
    right = (F.abs(F.col("_y2") - F.col("_y")) <= row) & (F.col("_x2") > F.col("_x"))
    under = (F.abs(F.col("_x2") - F.col("_x")) <= row) & (F.col("_y2") > F.col("_y") + row) & (F.col("_y2") <= F.col("_y") + below)
    near = F.when(right, F.struct(F.lit(0).alias("way"), (F.col("_x2") - F.col("_x")).alias("far"), F.col("_text").alias("t"))).when(under, F.struct(F.lit(1).alias("way"), (F.col("_y2") - F.col("_y")).alias("far"), F.col("_text").alias("t")))
    paired = label.join(other, form).groupBy(form, "_pos", "key").agg(F.min(near).alias("b")).where("b is not null").select(form, F.col("_pos").alias(pos), "key", F.col("b.t").alias("value"))
    return split.unionByName(paired)
