"""Quality rules with adaptive thresholds.

Each document gets counts of its words, symbols, repeated lines and repeated 8-word windows. Thresholds are not fixed: for
every language and source a mergeable quantile sketch holds the distribution of each measure, and documents far outside the
bulk of their own group are dropped. A sketch is a log-linear histogram (values keep their six leading bits, so the
relative error is below 1/32): buckets merge by adding counts, in any order, so partial sketches combine before the shuffle
and again behind it, and the sketches of sources add up to those of their language and of everything. A group that has too few
rows for its tail, or no spread, takes the fences of its language, and that in turn those of all rows. Thresholds are joined
back on (language, source).

DataFrame functions only. Measures are integers, so equal inputs give equal results everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherum.llm.common import WORD, materialise

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
SYMBOLS = "[#*$%&|<>]"
#: Measure: the percentile that its fence starts from, and how many times the way there from the median (in tenths) lies beyond it. Both
#: fences are 6.4 standard deviations out where values are normal. Measures that are zero nearly everywhere need the further tail.
MEASURES = {"mean_length": (90, 40), "symbol_rate": (99, 18), "dup_line_rate": (99, 18), "repeat_rate": (99, 18)}
#: Rows that a group must have beyond the percentile.
TAIL_ROWS = 10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words that lie in some 8-word window that occurs twice or more."""
    n = F.size(words)

    def pairs(hashes: Column, apart: int, last: int) -> Column:
        return F.transform(F.sequence(F.lit(0), n - last), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + apart)))

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))))
        places = F.sort_array(F.transform(twice, lambda x: x["p"]))
        return let(places, lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(WINDOW), lambda acc, i: acc + F.least(F.lit(WINDOW), F.get(p, i) - F.get(p, i - 1))))

    eights = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h1: let(pairs(h1, 1, 2), lambda h2: let(pairs(h2, 2, 4), lambda h4: pairs(h4, 4, 8))),
    )
    found = let(eights, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))
    return F.when(n > WINDOW, found).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of each row; null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), by_words.alias("w"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), by_lines.alias("l"))
        .select("doc_id", "lang", "source", "w.*", "n_symbols", "l.*")
        .withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"))
    )


def _rates() -> dict[str, Column]:
    words, chars, lines = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("n_lines", F.lit(1))
    whole = lambda a, b: F.floor(a / b)  # noqa: E731  counts stay far below 2**53
    return {
        "mean_length": whole(F.col("word_chars") * 1000, words),
        "symbol_rate": whole(F.col("n_symbols") * 10_000, chars),
        "dup_line_rate": whole(F.col("n_dup_lines") * 10_000, lines),
        "repeat_rate": whole(F.col("n_repeat_words") * 10_000, words),
    }


def bucket(value: str) -> Column:
    """Lower end of the sketch's bucket of a whole number that isn't negative."""
    drop = f"(length(bin({value})) - 6)"
    return F.expr(f"CASE WHEN {value} < 64 THEN {value} ELSE shiftleft(shiftright({value}, {drop}), {drop}) END")


#: Whose sketch: that of a language and source, of a language, of all rows.
LEVELS = ("group", "language", "all")


def sketches(measured: DataFrame) -> DataFrame:
    """(level, lang, source, measure, buckets): one mergeable sketch per group, an array of (low, n) in order.

    Languages and everything are sums over the counts of the groups, not over the rows again.
    """
    rates = measured.where("NOT base_failed").select("lang", "source", *[c.alias(k) for k, c in _rates().items()])
    long = rates.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in MEASURES])).alias("m")).select("lang", "source", "m.*")
    counted = long.groupBy("lang", "source", "measure", bucket("value").alias("low")).agg(F.count("*").alias("n"))
    null = F.lit(None).cast("string")
    owners = F.array(*[F.struct(F.lit(level).alias("level"), (F.col("lang") if k < 2 else null).alias("lang"), (F.col("source") if k < 1 else null).alias("source")) for k, level in enumerate(LEVELS)])
    merged = counted.select(F.explode(owners).alias("o"), "measure", "low", "n").groupBy("o", "measure", "low").agg(F.sum("n").alias("n"))
    return merged.groupBy("o", "measure").agg(F.sort_array(F.collect_list(F.struct("low", "n"))).alias("buckets")).select("o.*", "measure", "buckets")


def quantile(percent: Column | int) -> Column:
    """Lower end of the bucket with the value of rank ceil(percent / 100 * n)."""
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + b["n"])
    rank = F.floor((total * percent + 99) / 100)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))
    step = lambda a, b, need: F.struct((a["seen"] + b["n"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + b["n"] >= need, b["low"])).alias("at"))
    return let(rank, lambda need: F.aggregate("buckets", start, lambda a, b: step(a, b, need), lambda a: a["at"]))


def bucket_end(low: Column) -> Column:
    """The largest value of the bucket that begins at ``low``: what a quantile may be at most."""
    return let(low, lambda v: v + F.when(v < 64, F.lit(0).cast("long")).otherwise(F.floor(F.pow(F.lit(2.0), F.length(F.bin(v)) - 6)) - 1))


def fences(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, measure, low, high, usable): fences from the quantiles of each sketch."""
    tail = F.element_at(F.create_map(*[F.lit(x) for k, (p, _) in MEASURES.items() for x in (k, p)]), F.col("measure"))
    tenths = F.element_at(F.create_map(*[F.lit(x) for k, (_, t) in MEASURES.items() for x in (k, t)]), F.col("measure"))
    rows = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + b["n"])
    points = sketch.select("level", "lang", "source", "measure", rows.alias("n"), tail.alias("tail"), tenths.alias("tenths"), quantile(50).alias("middle"), bucket_end(quantile(tail)).alias("upper"), quantile(100 - tail).alias("lower"))
    out = lambda way: F.floor(way * F.col("tenths") / 10)
    return points.select(
        "level", "lang", "source", "measure",
        (F.col("lower") - out(F.col("middle") - F.col("lower"))).alias("low"), (F.col("upper") + out(F.col("upper") - F.col("middle"))).alias("high"),
        ((F.col("n") * (100 - F.col("tail")) >= TAIL_ROWS * 100) & (F.col("upper") > F.col("middle"))).alias("usable"),
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, then <measure>_low, <measure>_high, <measure>_level): the fences that hold for each group, and whose sketch gave them."""
    made = fences(sketch)
    own, language, everything = (made.where(F.col("level") == level) for level in LEVELS)
    end = lambda rows, p: rows.select("lang", "measure", F.struct("low", "high", "level").alias(p), F.col("usable").alias(f"{p}_usable"))
    second = end(language, "second").withColumnsRenamed({"lang": "lang2", "measure": "measure2"})
    third = end(everything, "third").select(F.col("measure").alias("measure3"), "third")
    joined = own.join(second, F.col("lang").eqNullSafe(F.col("lang2")) & (F.col("measure") == F.col("measure2"))).join(third, F.col("measure") == F.col("measure3"))
    chosen = joined.select("lang", "source", "measure", F.when(F.col("usable"), F.struct("low", "high", "level")).when(F.col("second_usable"), F.col("second")).otherwise(F.col("third")).alias("f"))
    return chosen.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == k, F.col("f")[e])).alias(f"{k}_{e}") for k in MEASURES for e in ("low", "high", "level")])


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, lang, source, the counts, base_failed, kept.

    Null or empty texts have zero counts and fail the base rules; a text of any length is read whole. Rows with a null language or
    source form groups of their own. Repeated rows stay and count as often as they occur, values at a fence stay inside; an empty
    table gives no rows; other columns are ignored.
    """
    measured = materialise(measure(docs, id_col, text_col, lang_col, source_col), "quality")
    limits = thresholds(sketches(measured)).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    # No broadcast hint: the groups may grow with the sources. Adaptive execution broadcasts a small table and splits hot groups of a large join.
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    inside = F.lit(True)
    for k, rate in _rates().items():
        inside = inside & (rate <= F.col(f"{k}_high"))
    inside = inside & (_rates()["mean_length"] >= F.col("mean_length_low"))
    return joined.select(*measured.columns, F.coalesce(~F.col("base_failed") & inside, F.lit(False)).alias("kept"))
