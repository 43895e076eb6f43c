"""Removal of long repeats across documents by a logarithmic family of suffix arrays.

The arrays are sparse: of all suffixes of the texts they hold those that start at sampled places. Every window of ``LENGTH`` bytes
samples the place in it whose next ``SEED`` bytes have the smallest hash (the leftmost of equal ones), so two equal windows sample
the same place. Windows that begin less than ``HALF`` bytes before their place are found by the suffix at the place, the others by
the suffix ``HALF`` bytes before it; so ``HEAD`` bytes of the suffix lie in the window in both cases, and one suffix in about thirteen is
kept. An array is a table of suffixes, in buckets and sorted within each, by their first eight bytes as a long in the order of the bytes and a
hash of the rest of the head; for suffixes that begin alike it names the smallest document.

A ``SuffixFamily`` takes batches of documents. The suffix array of a batch is merge-scanned against each level that is there: both are
bucketed by the same columns, so these joins move no rows. What comes out are the places in the batch, and in older documents, at
which a long match may lie. Then the array becomes a level, and levels of equal size merge into one of twice the size, so n batches
leave about log2(n) levels and each suffix is merged as often at most.

``_matches`` decides the places exactly. A run of windows that share a sampled place is compared with all others as a whole: rows of
equal bytes form a class, whose later documents lose the run whole. What is left is one class against another. For it windows are
put into groups of seven that have 44 bytes in common; groups whose 44 bytes occur in one class only end here, and the windows of
the others are compared one by one. All this is aggregates that combine before the shuffle, and joins that keep hot keys out of it;
no group of equal passages is ever held together, and equal texts are one text from the start.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherum.llm.common import discard, join_facts, keep_in_scope, materialise, scratch_path, scratch_scope

LENGTH = 50
#: Bytes whose hash samples places, bytes of a suffix that must agree before anything is compared, and how far windows may begin before a place to be found by its own suffix.
SEED, HEAD, HALF = 16, 32, 18
#: Batches that a whole table is dealt to.
BATCHES = 3
#: Windows of a run that are looked up by what they have in common.
GROUP = 7
_CODEC = "zstd"
_SPAN = LENGTH - SEED + 1
_BLOCK = 1 << 18
_PLACE = np.uint64((1 << 21) - 1)
_EMPTY = hashlib.sha256(b"").hexdigest()
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SIGN = np.uint64(1 << 63)


# ---- windows and their sampled places


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MULTIPLIERS[0]
    return h ^ (h >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of ``width`` values."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return values if step == width else np.minimum(values[: len(values) - (width - step)], values[width - step :])


def window_runs(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows that lie in one text and share a sampled place, in blocks of a bounded number of bytes.

    Text k is data[bounds[k]:bounds[k + 1]]. Arrays: first window, number of windows (``_SPAN`` at most), sampled place, text, and
    the heads (hi, lo) of the suffixes at the place and ``HALF`` bytes before it, which lie in the windows that need them.
    """
    for low in range(int(bounds[0]), int(bounds[-1]), _BLOCK):
        high = min(low + _BLOCK, int(bounds[-1]))
        m = high - low
        size = m + _SPAN + HEAD + SEED
        part = np.zeros(size, dtype=np.uint8)
        own = data[low : low + size]
        part[: len(own)] = own
        words = np.lib.stride_tricks.as_strided(part, (size - 7, 8), (1, 1)).copy().view("<u8").ravel()
        mixed = _mixed(words)
        h = _mixed(mixed[: m + _SPAN - 1] * _MULTIPLIERS[1] + words[8 : m + _SPAN + 7])
        place = (_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), _SPAN) & _PLACE).astype(np.int64)
        inner = bounds[np.searchsorted(bounds, low, "right") : np.searchsorted(bounds, high + LENGTH, "right")] - low
        breaks = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(place[1:] != place[:-1]) + 1, inner, inner - LENGTH + 1])
        start = np.unique(breaks[(breaks >= 0) & (breaks < m)])
        count = np.diff(np.r_[start, m])
        text = np.searchsorted(bounds, start + low, "right") - 1
        ok = start + low + LENGTH <= bounds[text + 1]
        start, count, text = start[ok], count[ok], text[ok]
        at = place[start]
        heads = []
        for k in (at, np.maximum(at - HALF, 0)):
            heads.append((words[k].byteswap() ^ _SIGN).view(np.int64))
            heads.append(_mixed(mixed[k + 8] * _MULTIPLIERS[2] + _mixed(mixed[k + 16] * _MULTIPLIERS[1] + words[k + 24])).view(np.int64))
        yield start + low, count, at + low, text, *heads


def _near_and_far(start: np.ndarray, count: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs have windows that begin less than ``HALF`` bytes before their place, and which have others."""
    return at - start - count + 1 < HALF, at - start >= HALF


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls and the bounds of its values."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8), bounds


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo, doc, others): the heads of the sampled suffixes of rows (doc, text). Documents of a batch that have a head in common are one row: the smallest, and the others."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        runs = list(window_runs(*_bytes_of(batch.column(1))))
        if not runs:
            continue
        start, count, at, text, *heads = (np.concatenate(x) for x in zip(*runs))
        near, far = _near_and_far(start, count, at)
        hi, lo = (np.r_[heads[k][near], heads[k + 2][far]] for k in (0, 1))
        doc = ids[np.r_[text[near], text[far]]]
        order = np.lexsort((doc, lo, hi))
        hi, lo, doc = hi[order], lo[order], doc[order]
        same = (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])
        fresh = np.r_[True, ~(same & (doc[1:] == doc[:-1]))]
        hi, lo, doc = hi[fresh], lo[fresh], doc[fresh]
        first = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]) if len(hi) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(hi)])
        rest = np.ones(len(hi), dtype=bool)
        rest[first] = False
        others = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes - 1)].astype(np.int32)), pa.array(doc[rest]), mask=pa.array(sizes == 1))
        yield pa.RecordBatch.from_arrays([pa.array(hi[first]), pa.array(lo[first]), pa.array(doc[first]), others], names=["hi", "lo", "doc", "others"])


# ---- written tables


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go once its table is there, not whenever the driver collects its garbage. Buckets of one file are taken as sorted, as they were written: what joins or groups them by their columns sorts and hashes nothing."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.execution.replaceHashWithSortAgg": "true"}
    before = {key: spark.conf.get(key, "false") for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    with _own_shuffles(df.sparkSession):
        df.write.option("compression", _CODEC).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    keep_in_scope(path)
    return out


class _Tables:
    """Bucketed tables of one piece of work. Their files are in the shared folder; ``drop`` forgets their names and deletes them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.names = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, df: DataFrame, label: str, *keys: str) -> DataFrame:
        """``df``, which is dealt out by ``keys`` already or is small, in buckets by them and sorted within."""
        path, name = scratch_path(self.spark, label), f"gatherum_{uuid.uuid4().hex}"
        with _own_shuffles(self.spark):
            df.write.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", path).option("compression", _CODEC).saveAsTable(name)
        self.names.append(name)
        out = self.spark.table(name)
        out._scratch, out._name = path, name
        keep_in_scope(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {df._name}")
            self.names.remove(df._name)
        discard(*tables)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []


# ---- the family


class SuffixFamily:
    """Levels of suffix arrays, each of a power of two of batches, largest first."""

    def __init__(self, tables: _Tables) -> None:
        self.tables = tables
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """(doc, hi, lo), some more than once: documents of the batch (doc, text) and of older ones with a suffix whose head another document has.

        A head of older documents that had been in one of them only brings that one; the others were given when they met. After
        the ``last`` batch no level is written.
        """
        keys = ("hi", "lo")
        rows = batch.select("doc", "text").mapInArrow(_suffixes, "hi long, lo long, doc long, others array<long>")
        fresh = self.tables.write(rows.repartition(self.tables.buckets, *keys), "suffix-batch", *keys)
        own = fresh.groupBy(*keys).agg(F.min("doc").alias("first"), F.max(F.coalesce(F.element_at("others", -1), F.col("doc"))).alias("last"))
        scan, older, met = own, [], F.col("last") > F.col("first")
        for k, (_, level) in enumerate(self.levels):
            scan = scan.join(level.select(*keys, F.col("first").alias(f"first{k}"), F.col("shared").alias(f"shared{k}")), list(keys), "left")
            met = met | F.col(f"first{k}").isNotNull()
            older.append(F.when(~F.col(f"shared{k}"), F.col(f"first{k}")))
        scan = scan.where(met).select(*keys, F.filter(F.array(*older), lambda d: d.isNotNull()).alias("older") if older else F.array().cast("array<long>").alias("older"))
        shared = self.tables.write(scan, "suffix-shared", *keys)
        here = fresh.join(shared.select(*keys), list(keys), "left_semi").select(F.explode(F.concat(F.array("doc"), F.coalesce("others", F.array().cast("array<long>")))).alias("doc"), *keys)
        hits = _written(here.unionByName(shared.select(F.explode("older").alias("doc"), *keys)), "suffix-hits")
        if not last:
            self._push(own.select(*keys, "first", (F.col("last") > F.col("first")).alias("shared")))
        self.tables.drop(fresh, shared)
        return hits

    def _push(self, level: DataFrame) -> None:
        """The array of a batch becomes a level; while the last level is of the same size, both are merged, bucket by bucket."""
        size, read = 1, []
        while self.levels and self.levels[-1][0] == size:
            other = self.levels.pop()[1]
            a, b = level.alias("a"), other.alias("b")
            seen = lambda c: F.coalesce(c, F.lit(False))
            shared = (F.col("a.first").isNotNull() & F.col("b.first").isNotNull()) | seen("a.shared") | seen("b.shared")
            level = self.tables.write(a.join(b, ["hi", "lo"], "full_outer").select("hi", "lo", F.least("a.first", "b.first").alias("first"), shared.alias("shared")), "suffix-level", "hi", "lo")
            self.tables.drop(other, *read)
            size, read = 2 * size, [level]
        self.levels.append((size, level if read else self.tables.write(level, "suffix-level", "hi", "lo")))


# ---- exact matches


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in an array that is sorted and not empty."""
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (doc, nth, s0, n, a, bytes) of rows (doc, nth, text, heads) at one of the row's heads; ``a`` is how far the place is from the first window."""
    for batch in batches:
        heads = batch.column(3)
        row = np.repeat(np.arange(batch.num_rows), heads.value_lengths().to_numpy(zero_copy_only=False))
        mine = heads.flatten()
        code = lambda hi, lo, k: _mixed(_mixed(hi.view(np.uint64)) * _MULTIPLIERS[1] + _mixed(lo.view(np.uint64) + k.astype(np.uint64) * _MULTIPLIERS[2]))
        wanted = np.sort(code(mine.field(0).to_numpy(), mine.field(1).to_numpy(), row))
        if not len(wanted):
            continue
        data, bounds = _bytes_of(batch.column(2))
        for start, count, at, text, hi, lo, far_hi, far_lo in window_runs(data, bounds):
            near, far = _near_and_far(start, count, at)
            near &= _among(code(hi, lo, text), wanted)
            far &= _among(code(far_hi, far_lo, text), wanted)
            first = np.where(far, start, np.maximum(start, at - HALF + 1))
            count = np.where(near, start + count, np.minimum(start + count, at - HALF + 1)) - first
            on = near | far
            start, count, at, text = first[on], count[on], at[on], text[on]
            length = count + LENGTH - 1
            ends = np.cumsum(length)
            inside = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)
            raw = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data[inside])])
            picked = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(picked), batch.column(1).take(picked), pa.array(start - bounds[text]), pa.array(count.astype(np.int32)), pa.array((at - start).astype(np.int32)), raw], names=["doc", "nth", "s0", "n", "a", "bytes"]
            )


def _digest(raw: Column) -> Column:
    return F.unhex(F.md5(raw))


def _matches(runs: DataFrame, tables: _Tables) -> DataFrame:
    """(doc, nth, s0, n, mask) of the runs with windows that a smaller document has, too; of the windows those whose bit is set in ``mask``, or all where it is null."""
    keyed = runs.withColumn("key", _digest(F.col("bytes")))
    classes = keyed.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("final"), F.max("n").alias("n"), F.max("a").alias("a"), F.count("*").alias("size"), F.first("bytes").alias("bytes"))
    classes = tables.write(classes.withColumn("class", F.monotonically_increasing_id()), "suffix-classes", "key")
    # Groups of windows, by a hash of the bytes that all seven have in common; a wrong hit costs some work, as windows are compared exactly.
    groups = classes.select("key", "first", "a", "bytes", F.explode(F.sequence(*[F.floor(x / GROUP).cast("int") for x in (F.col("a") - F.col("n") + 1, F.col("a"))])).alias("g"))
    groups = _written(groups.select(F.xxhash64(F.substring("bytes", (F.col("a") - GROUP * F.col("g") + 1).cast("int"), F.lit(LENGTH - GROUP + 1)), "g").alias("core"), "key", "first", "g"), "suffix-groups")
    cores = groups.groupBy("core").agg(F.min("first").alias("least"), F.max("first").alias("most"), F.count("*").alias("size"))
    cores = _written(cores.where("least < most").select("core", "size"), "suffix-cores")
    live = join_facts(groups, cores, "core", "size", groups.count()).groupBy("key").agg(F.collect_list("g").alias("gs"))
    # Their windows, one by one.
    number = F.flatten(F.transform("gs", lambda g: F.sequence(F.greatest(F.lit(0), F.col("a") - GROUP * g - GROUP + 1), F.least(F.col("n") - 1, F.col("a") - GROUP * g))))
    windows = classes.join(live.hint("merge"), "key").select("class", "first", "bytes", F.explode(number).alias("j"))
    windows = _written(windows.select(_digest(F.substring("bytes", F.col("j") + 1, F.lit(LENGTH))).alias("window"), "class", "first", "j"), "suffix-windows")
    discard(groups, cores)
    firsts = windows.groupBy("window").agg(F.min("first").alias("least"), F.max("first").alias("most"), F.count("*").alias("size"))
    firsts = _written(firsts.where("least < most").select("window", "least", "size"), "suffix-firsts")
    taken = join_facts(windows, firsts, "window", "size", windows.count()).where("first > least")
    masks = _written(taken.groupBy("class").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j"))).alias("mask")), "suffix-masks")
    discard(windows, firsts)
    ends = _written(classes.select("class", "key", "first", "final", "size").join(masks, "class", "left").where("final > first or mask is not null").select("key", "first", "mask", "size"), "suffix-ends")
    tables.drop(classes)
    discard(masks)
    found = join_facts(keyed.select("key", "doc", "nth", "s0", "n"), ends, "key", "size", runs.count())
    return found.where("doc > first or mask is not null").select("doc", "nth", "s0", "n", F.when(F.col("doc") == F.col("first"), F.col("mask")).alias("mask"))


def kept_spans(starts: np.ndarray, size: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal removed runs, given the starts of removed windows."""
    starts = np.unique(starts)
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > length)
    return starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]] + length


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, sha, n_removed, n_spans, kept) of rows (doc, nth, sha, text, spans)."""
    for batch in batches:
        data, bounds = _bytes_of(batch.column(3))
        spans = batch.column(4)
        edges = np.r_[0, np.cumsum(spans.value_lengths().to_numpy(zero_copy_only=False))]
        nth, s0, n, mask = (spans.flatten().field(k) for k in range(4))
        nth, s0, n, bits = nth.to_numpy(), s0.to_numpy(), n.to_numpy().astype(np.int64), mask.fill_null(-1).to_numpy()
        own_nth = batch.column(1).to_numpy()
        rows = []
        for k in range(batch.num_rows):
            part = slice(edges[k], edges[k + 1])
            mine = nth[part] == own_nth[k]
            first, count, on = s0[part][mine], n[part][mine], bits[part][mine]
            j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            starts = (np.repeat(first, count) + j)[(np.repeat(on, count) >> j) & 1 == 1]
            text = data[bounds[k] : bounds[k + 1]]
            a, b = kept_spans(starts, len(text))
            kept = hashlib.sha256()
            for x, y in zip(np.r_[0, b], np.r_[a, len(text)]):
                kept.update(text[x:y].tobytes())
            rows.append((int((b - a).sum()), len(a), kept.hexdigest()))
        removed, count, kept = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.string())], names=["doc", "sha", "n_removed", "n_spans", "kept"])


# ---- whole tables


def _one_of_each(docs: DataFrame, classes: DataFrame, tables: _Tables) -> DataFrame:
    """(doc, nth, sha, text) of one document for each text, the smallest; in buckets by doc. Texts of one id are told apart by ``nth``. The one shuffle of texts."""
    texts = classes.groupBy(F.col("first").alias("doc")).agg(F.sort_array(F.collect_list("sha")).alias("shas"))
    rows = docs.join(texts.hint("merge"), "doc").withColumn("nth", F.array_position("shas", F.col("sha")).cast("int")).where("nth > 0")
    return tables.write(rows.select("doc", "nth", "sha", "text"), "suffix-texts", "doc")


def _batches(texts: DataFrame, batches: int) -> list[DataFrame]:
    """Texts by ranges of their ids, about as many in each."""
    shares = [k / batches for k in range(1, batches)]
    cuts = sorted(set(texts.agg(F.percentile_approx("doc", shares, 10_000)).first()[0] or [])) if shares else []
    doc = F.col("doc")
    ranges = zip([None, *cuts], [*cuts, None])
    return [texts.where(F.lit(True) if low is None else doc > low).where(F.lit(True) if high is None else doc <= high) for low, high in ranges]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if it is in a string of ``LENGTH`` bytes that starts in a document with a smaller id, too, wherever in it. Strings
    are those of the input, in bytes; they may start within a character. A null text is empty. Rows with one id aren't smaller than
    each other and lose nothing to each other; a null id is smaller than none and larger than none, so such a row loses nothing and
    takes nothing. Texts of any length are read in blocks; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    facts = materialise(rows.select("doc", "sha", F.length("text").cast("long").alias("n_bytes")), "repeats-rows")
    compared = "doc is not null and n_bytes >= " + str(LENGTH)
    tables = _Tables(spark)
    try:
        with scratch_scope(spark):
            classes = _written(facts.where(compared).groupBy("sha").agg(F.min("doc").alias("first"), F.count("*").alias("size")), "repeats-classes")
            texts = _one_of_each(rows.where(F.col("doc").isNotNull() & (F.length("text") >= LENGTH)), classes, tables)
            family = SuffixFamily(tables)
            parts = _batches(texts, batches)
            hits = [family.add(part, last=k == len(parts) - 1) for k, part in enumerate(parts)]
            every = hits[0]
            for more in hits[1:]:
                every = every.unionByName(more)
            tables.drop(*[level for _, level in family.levels])
            heads = every.groupBy("doc").agg(F.collect_set(F.struct("hi", "lo")).alias("heads"))
            runs = _written(texts.join(heads.hint("merge"), "doc").select("doc", "nth", "text", "heads").mapInArrow(_marked, "doc long, nth int, s0 long, n int, a int, bytes binary"), "suffix-runs")
            discard(*hits)
            spans = _matches(runs, tables).groupBy("doc").agg(F.collect_list(F.struct("nth", "s0", "n", "mask")).alias("spans"))
            cut = texts.join(spans.hint("merge"), "doc").select("doc", "nth", "sha", "text", "spans").mapInArrow(_cut, "doc long, sha binary, n_removed long, n_spans long, kept string")
            cut = _written(cut.dropDuplicates(["doc", "sha"]), "suffix-cut")
            own = join_facts(facts.where(compared), classes, "sha", "size", facts.count()).join(cut, ["doc", "sha"], "left")
            copy = F.col("doc") > F.col("first")
            value = lambda whole, part, none: F.when(copy, whole).otherwise(F.coalesce(F.col(part), none))
            done = own.select("doc", "sha", "n_bytes", value(F.col("n_bytes"), "n_removed", F.lit(0)).alias("n_removed"), value(F.lit(1), "n_spans", F.lit(0)).alias("n_spans"), value(F.lit(_EMPTY), "kept", F.lower(F.hex("sha"))).alias("kept_sha256"))
            rest = facts.where(f"not coalesce({compared}, false)").select("doc", "sha", "n_bytes", F.lit(0).alias("n_removed"), F.lit(0).alias("n_spans"), F.lower(F.hex("sha")).alias("kept_sha256"))
            done = done.unionByName(rest).select(F.col("doc").alias("doc_id"), "n_bytes", F.col("n_removed").cast("long").alias("n_removed"), F.col("n_spans").cast("long").alias("n_spans"), "kept_sha256")
            path = scratch_path(spark, "repeats")
            with _own_shuffles(spark):
                done.write.parquet(path)
        return spark.read.schema(done.schema).parquet(path)
    finally:
        tables.close()
