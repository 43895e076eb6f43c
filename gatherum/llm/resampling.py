"""Importance resampling towards a target distribution, by hashed n-gram features.

Features of a text are its runs of one to three words, hashed to ``BUCKETS`` buckets by CRC-32. Two scans: one counts the buckets
of both corpora (each task adds up a table of buckets, so a row for each bucket and task is all that is shuffled), one adds up the
gains of a document's features from an array of one gain for each bucket. Scores are integers; the draw is exact: a histogram of
scores, summed from the top, tells at which rank each score starts and where the draw ends, and within a score that survives the
ids decide. CRC-32 is linear, so that of a run of words is combined from those of its words, for a whole batch at once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatherum.llm.common import materialise

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 5
SEED = 42
#: A word, once A-Z are lower-cased: digits, letters and everything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words whose CRC a worker remembers, and the longest that it does.
_MEMO, _MEMO_WORD = 1 << 18, 64
_TAKE = 1 << 18


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_TABLE = _byte_table()


def _doubled(shift: np.ndarray) -> np.ndarray:
    return _moved(shift[None], np.zeros(1024, int), shift.ravel()).reshape(4, 256)


def _moved(shifts: np.ndarray, which: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Each CRC moved on by zero bytes: ``shifts[which]`` are tables of what each byte of a CRC contributes."""
    flat = shifts.reshape(-1)
    at = which.astype(np.int64) * 1024
    out = flat[at + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out = out ^ flat[at + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def _shift_tables() -> np.ndarray:
    """Table k moves a CRC on by 2^k bytes."""
    values = (np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    tables = [_TABLE[values & np.uint32(255)] ^ (values >> np.uint32(8))]
    while len(tables) < 31:
        tables.append(_doubled(tables[-1]))
    return np.stack(tables)


_SHIFTS = _shift_tables()
_SHORT = 64


def _short_tables() -> np.ndarray:
    """Table k moves a CRC on by k bytes."""
    values = (np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    tables = [values]
    while len(tables) < _SHORT:
        last = tables[-1]
        tables.append(_TABLE[last & np.uint32(255)] ^ (last >> np.uint32(8)))
    return np.stack(tables)


_STEPS = _short_tables()


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of A + " " + B from those of A and B and the length of B in bytes."""
    spaced = _TABLE[(left ^ np.uint32(0xFFFFFFFF) ^ np.uint32(32)) & np.uint32(255)] ^ ((left ^ np.uint32(0xFFFFFFFF)) >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
    if length.max(initial=0) < _SHORT:
        return _moved(_STEPS, length, spaced) ^ right
    for k in range(int(length.max()).bit_length()):
        on = np.flatnonzero(length >> k & 1)
        spaced[on] = _moved(_SHIFTS[k][None], np.zeros(len(on), int), spaced[on])
    return spaced ^ right


class _Words(dict):
    """Word to CRC and length in one integer."""

    def __missing__(self, word: bytes) -> int:
        code = zlib.crc32(word) | len(word) << 32
        if len(word) <= _MEMO_WORD:
            if len(self) >= _MEMO:
                self.clear()
            self[word] = code
        return code


def feature_blocks(texts: list[bytes | None], words: _Words) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Blocks of texts: bucket of each feature, number of the text that each feature is of, number of words of each text of the block."""
    held: list[int] = []
    counts: list[int] = []
    for text in texts:
        own = list(map(words.__getitem__, _WORD.findall(text.lower()))) if text else []
        held += own
        counts.append(len(own))
        if len(held) >= _TAKE:
            yield (*_features(held, counts), counts)
            held, counts = [], []
    if counts:
        yield (*_features(held, counts), counts)


def _features(codes: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    code = np.array(codes, dtype=np.int64)
    of = np.repeat(np.arange(len(counts)), counts)
    crc, length = (code & 0xFFFFFFFF).astype(np.uint32), code >> 32
    parts, owners = [crc], [of]
    for k in (1, 2):
        if len(code) > k:
            crc = joined_crc(crc[:-1], (code[k:] & 0xFFFFFFFF).astype(np.uint32), length[k:])
            within = of[k:] == of[:-k]
            parts.append(crc[within])
            owners.append(of[k:][within])
    return (np.concatenate(parts) % np.uint32(BUCKETS)).astype(np.int64), np.concatenate(owners)


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(BUCKETS, dtype=np.int64), _Words()
        for batch in batches:
            for bucket, _, _ in feature_blocks(batch.column(0).to_pylist(), words):
                total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text") -> np.ndarray:
    """The gain of each bucket: how much likelier it is in the target than in the documents, as floor(1000 * ln(ratio)), add-one smoothed."""
    both = bucket_counts(docs, text_col).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(bucket_counts(target, target_col).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # BUCKETS rows at most
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths, the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for bucket, of, counts in feature_blocks(batch.column(1).to_pylist(), words):
                n_words += counts
                n_features.append(np.bincount(of, minlength=len(counts)))
                total = np.zeros(len(counts), dtype=np.int64)
                np.add.at(total, of, gain[bucket])
                weights.append(total)
            none = [np.zeros(0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(np.concatenate(n_features or none)), pa.array(np.concatenate(weights or none))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def numbered(rows: DataFrame, draw: int) -> tuple[DataFrame, int | None]:
    """(rows from the cutoff score on, with their ``rank`` from the top, and that score); no score if nothing is drawn.

    The cutoff is the score that holds the row of rank ``draw``. Rows of one score go by doc_id (a null id last). The histogram has a
    row for each score that occurs. It is summed from the top in two steps, over blocks of scores and within each block; a block is as
    wide as the square root of the range of scores, so no window spans more rows than that. The rows of one score are few: the noise
    spreads even equal weights so that none has over 0.04 % of them.
    """
    histogram = materialise(rows.groupBy("score").agg(F.count("*").alias("n")), "resampling-histogram")
    low, high = histogram.agg(F.min("score"), F.max("score")).first()
    histogram = histogram.withColumn("block", F.floor((F.col("score") - (low or 0)) / (1 + math.isqrt((high or 0) - (low or 0)))))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = histogram.groupBy("block").agg(F.sum("n").alias("n")).select("block", before(Window.orderBy(F.desc("block"))).alias("start"))
    offsets = histogram.join(blocks.where(F.col("start") < draw), "block").select("score", (F.col("start") + before(Window.partitionBy("block").orderBy(F.desc("score")))).alias("above"))
    offsets = materialise(offsets.where(F.col("above") < draw), "resampling-offsets")
    cutoff = offsets.agg(F.min("score")).first()[0]
    if cutoff is None:
        return rows.withColumn("rank", F.lit(None).cast("long")), None
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    return rows.where(F.col("score") >= cutoff).join(offsets, "score").withColumn("rank", (F.col("above") + F.row_number().over(order)).cast("long")).drop("above"), cutoff


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: int = SHARE, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document with doc_id, n_features, weight, score, and rank (1, 2, ... of those drawn, else null).

    Of the N documents with at least ``least`` words, floor(share * N / 100) of the highest score are drawn. Null texts and texts
    without a word have no features and weight zero; texts are read whole, in any number of words; repeated rows are documents of
    their own and may both be drawn; a null id counts as an empty one and comes last in a score; other columns are ignored; an empty
    table gives no rows, and an empty target leaves the gains to add-one smoothing.
    """
    rows = materialise(scored(docs, gains(docs, target, text_col, target_col), id_col, text_col, seed), "resampling-scores")
    able = F.col("n_words") >= least
    draw = share * rows.where(able).count() // 100
    top, cutoff = numbered(rows.where(able), draw)
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long")
    if cutoff is None:
        return rows.select(*columns, none.alias("rank"))
    rest = rows.where(~able | (F.col("score") < cutoff)).select(*columns, none.alias("rank"))
    return rest.unionByName(top.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank")))
