"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items and documents are cut into word n-grams (three words; items of one or two words are one n-gram of their length),
each a 64-bit code. First scan of the documents: in how many of them each n-gram of an item occurs. An item's seeds are its
rare n-grams: those in no more than a small share of the documents, and always those within a few times the median of the
item's own, so that an item that thousands of documents quote, whole or edited, still has seeds. Second scan: texts that hold
a seed are set aside with the places of their hits; hits join seeds by code, which gives the pairs of text and item. Around the
hits of a pair a passage is cut that is wide enough for any alignment that can reach the threshold, and aligned word by word.

Both scans look n-grams up in a Bloom filter of at most ``FILTER_BITS`` bits, built by a distributed aggregate; it is all that
is sent to the executors, however many items there are, and what it lets through wrongly is dropped by the joins. Equal texts
are one text until the last step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherum.llm.common import materialise

NGRAM = 3
#: An n-gram in more than this share of the documents is rare only relative to its item; 1 makes every n-gram a seed.
RARE_SHARE = 0.0005
#: N-grams in no more documents than this are rare, and so are those in no more than this many times the item's median.
RARE_LEAST, RARE_MEDIANS = 16, 4
#: Least score of a leak: the alignment's score as a share of that of the item with itself.
THRESHOLD = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the filter for an n-gram, and the most of all (16 MB).
BITS_EACH, FILTER_BITS = 1024, 1 << 27
_WORD = re.compile(r"\w+")
#: Scripts that are written without spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han. Each letter is a word.
_UNSPACED = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)))
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]").search
_MIXED_WORD = re.compile(rf"(?=\w)[{_UNSPACED}]|[^\W{_UNSPACED}]+")
#: Characters that are hashed at once (or one text), and texts that a worker remembers.
_CHUNK_CHARS, _SEEN_TEXTS = 1 << 18, 1 << 16
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[str]:
    low = (text or "").lower()
    return _WORD.findall(low) if low.isascii() or not _ANY_UNSPACED(low) else _MIXED_WORD.findall(low)


#: Unicode has no letters or digits from here on.
_WORDS_END = 0x40000
#: A word is the sum of its code points times powers of this, which is odd and so has an inverse.
_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _kinds() -> np.ndarray:
    """Of each code point: 1 in words, 2 a word of its own, 0 in none."""
    if "kinds" not in _tables:
        _tables["kinds"] = np.array([(chr(c) == "_" or chr(c).isalnum()) * (2 if _ANY_UNSPACED(chr(c)) else 1) for c in range(_WORDS_END)], dtype=np.uint8)
    return _tables["kinds"]


def _powers(base: int, n: int) -> np.ndarray:
    """At least the first ``n`` powers, modulo 2**64."""
    name = f"powers {base}"
    if name not in _tables or len(_tables[name]) < n:
        steps = np.full(max(n, 4 * _CHUNK_CHARS), base, dtype=np.uint64)
        steps[0] = 1
        _tables[name] = np.multiply.accumulate(steps)
    return _tables[name]


def numbered_all(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts in order, number of words up to the end of each text): ``words`` of each, by array operations."""
    parts = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    points = np.frombuffer(b"\n\0\0\0".join([*parts, b""]), dtype="<u4")  # a character in no word behind each text
    stops = np.cumsum([len(p) // 4 + 1 for p in parts])
    kind = _kinds()[np.minimum(points, _WORDS_END - 1)]
    inside, single = kind > 0, kind == 2
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | single[1:] | single[:-1]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(points))[: len(points)], out=sums[1:])
    code = (sums[np.flatnonzero(ends) + 1] - sums[start]) * _powers(pow(_BASE, -1, 1 << 64), len(points))[start]
    code ^= code >> np.uint64(32)
    code *= _MIX
    return code, np.searchsorted(start, stops)


def numbered(text: str | None) -> np.ndarray:
    return numbered_all([text])[0]


def codes(numbers: np.ndarray, size: int) -> np.ndarray:
    """The code of the n-gram of ``size`` words at each place."""
    n = max(0, len(numbers) - size + 1)
    code = numbers[:n] + np.uint64(size)
    for k in range(1, size):
        code *= _FACTOR
        code += numbers[k : k + n]
    code ^= code >> np.uint64(32)
    code *= _MIX
    code ^= code >> np.uint64(29)
    return code


class Filter:
    """Bloom filter with two bits for a code; the low and the high half of the code name them."""

    def __init__(self, bits: np.ndarray, sizes: tuple[int, ...]):
        self.bits, self.sizes, self.mask = bits, sizes, np.uint64(len(bits) * 8 - 1)

    def _set(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def hits(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the text, place, code) of n-grams that may be known, for a run of texts at a time, by text and place."""
        first = held = 0
        for i, text in enumerate(texts):
            held += len(text or "")
            if held >= _CHUNK_CHARS or i + 1 == len(texts):
                yield self._of_run(first, texts[first : i + 1])
                first, held = i + 1, 0

    def _of_run(self, first: int, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers, stops = numbered_all(texts)
        owners, places, found = [], [], []
        for size in self.sizes:
            code = codes(numbers, size)
            at = np.flatnonzero(self._set(code & self.mask))
            at = at[self._set(code[at] >> np.uint64(32) & self.mask)]
            owner = np.searchsorted(stops, at, side="right")
            whole = at + size <= stops[owner]  # not from one text into the next
            owners.append(owner[whole])
            places.append((at - np.r_[0, stops][owner])[whole])
            found.append(code[at[whole]])
        owner, place, code = map(np.concatenate, (owners, places, found))
        order = np.lexsort((place, owner))
        return first + owner[order], place[order], code[order]


def make_filter(grams: DataFrame) -> Filter:
    """The filter of the codes in ``grams`` (code, size). At most FILTER_BITS bits reach the driver, in pieces of 4 KB."""
    sizes = grams.groupBy("size").agg(F.count("*").alias("n")).collect()  # NGRAM rows at most
    wanted = max(1 << 16, BITS_EACH * sum(r["n"] for r in sizes))
    bits = min(FILTER_BITS, 1 << (wanted - 1).bit_length())
    halves = grams.select(F.explode(F.array(F.col("code"), F.shiftrightunsigned("code", 32))).alias("half"))
    place = halves.select((F.col("half").bitwiseAND(bits - 1) + 1).alias("at"))
    pieces = place.groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for piece, part in zip(pieces.column(0).to_pylist(), pieces.column(1).to_pylist()):
        out[(piece - 1) * 4096 : piece * 4096] = np.frombuffer(part, dtype=np.uint8)
    return Filter(out, tuple(sorted(r["size"] for r in sizes)))


def item_table(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (a key of id and text), item_id, n (words), tokens (bytes), size, grams: one row per distinct item with a word and an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [numbered(t) for t in batch.column(2).to_pylist()]
            kept = np.array([len(t) > 0 for t in tokens], dtype=bool)
            part, tokens = batch.filter(pa.array(kept)), [t for t in tokens if len(t)]
            sizes = [min(NGRAM, len(t)) for t in tokens]
            grams = [np.unique(codes(t, s)).view(np.int64) for t, s in zip(tokens, sizes)]
            columns = [pa.array(list(map(len, tokens)), pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary()), pa.array(sizes, pa.int32()), pa.array(grams, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["item", "item_id", "n", "tokens", "size", "grams"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    return rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").mapInArrow(run, "item long, item_id long, n long, tokens binary, size int, grams array<long>")


def document_frequencies(texts: DataFrame, grams: Filter) -> DataFrame:
    """(code, n): in how many rows of ``texts`` each n-gram that the filter lets through occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, _, code in grams.hits(batch.column(0).to_pylist()):
                order = np.lexsort((owner, code))
                owner, code = owner[order], code[order]
                new = np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])] if len(code) else np.zeros(0, dtype=bool)
                values, counts = np.unique(code[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["code", "n"])

    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def seed_table(items: DataFrame, frequencies: DataFrame, n_docs: int, rare_share: float = RARE_SHARE) -> DataFrame:
    """(code, size, item, n): the seeds of each item."""
    grams = items.select("item", "n", "size", F.explode("grams").alias("code"))
    counted = grams.join(frequencies.withColumnRenamed("n", "docs"), "code", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    medians = counted.groupBy("item").agg(F.median("docs").alias("middle"))
    limit = F.greatest(F.lit(float(RARE_LEAST)), F.lit(float(rare_share * n_docs)), F.col("middle") * RARE_MEDIANS)
    return counted.join(medians, "item").where(F.col("docs") <= limit).select("code", "size", "item", "n")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: (best score, start, end of the passage's part); the first best place counts.

    Works by anti-diagonals, so that each step is one array operation over the item.
    """
    n, m = len(item), len(passage)
    if not n or not m:
        return 0, 0, 0
    prev = np.zeros(n + 1, dtype=np.int64)
    prev2 = np.zeros(n + 1, dtype=np.int64)
    from1 = np.full(n + 1, 0, dtype=np.int64)
    from2 = np.full(n + 1, 0, dtype=np.int64)
    best = (0, 0, 0)
    i = np.arange(1, n + 1)
    for d in range(2, n + m + 1):
        j = d - i
        real = (j >= 1) & (j <= m)
        same = np.zeros(n, dtype=bool)
        same[real] = item[i[real] - 1] == passage[j[real] - 1]
        diagonal = prev2[:-1] + np.where(same, MATCH, MISMATCH)
        up, side = prev[:-1] + GAP, prev[1:] + GAP
        score = np.maximum(np.maximum(diagonal, np.maximum(up, side)), 0)
        origin = np.where(score == diagonal, np.where(prev2[:-1] > 0, from2[:-1], j - 1), np.where(score == up, from1[:-1], from1[1:]))
        score[~real] = 0
        now, where = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        now[1:], where[1:] = score, origin
        k = int(np.argmax(now))
        if now[k] > best[0]:
            best = (int(now[k]), int(where[k]), d - k)
            if best[0] == MATCH * n:  # none can score more
                break
        prev2, prev, from2, from1 = prev, now, from1, where
    return best


def reach(length: int, threshold: float) -> int:
    """The most words of a text that an alignment with ``length`` words can span and still reach the threshold.

    A perfect alignment scores MATCH * length; what it may lose at most goes furthest as gaps of one word each.
    """
    return length + int(MATCH * length * (1 - threshold) / -GAP + 1e-9)


def passages(places: np.ndarray, length: int, size: int, threshold: float) -> list[tuple[int, int]]:
    """Stretches of a text around seeds that any good alignment with one of them lies in; touching ones are united."""
    margin = reach(length, threshold) + NGRAM
    out: list[tuple[int, int]] = []
    for p in np.unique(places).tolist():
        lo, hi = max(0, p - margin), min(size, p + margin)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def in_common(item: np.ndarray, part: np.ndarray) -> int:
    """Words that an item and a passage share, repeats included: no alignment can match more."""
    known, counts = np.unique(item, return_counts=True)
    k = np.minimum(np.searchsorted(known, part), len(known) - 1)
    return int(np.minimum(np.bincount(k[known[k] == part], minlength=len(known)), counts).sum())


def best_alignment(item: np.ndarray, starts: list[int], parts: list[np.ndarray], threshold: float) -> tuple[float, int, int] | None:
    """(share of a perfect score, first word, one past the last) of the best passage, the first of equal ones; None below the threshold."""
    best = (0, 0, 0)
    for lo, part in zip(starts, parts):
        if in_common(item, part) < threshold * len(item):
            continue
        score, s, e = align(item, part)
        if score > best[0]:
            best = (score, lo + s, lo + e)
    share = best[0] / (MATCH * len(item))
    return (round(share, 6), best[1], best[2]) if share >= threshold else None


def text_key(text: Column) -> list[Column]:
    """A 128-bit key of a text, in two columns."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def _texts_with_hits(texts: DataFrame, seeds: Filter) -> DataFrame:
    """(k1, k2, text, codes, places) of the texts that hold what may be a seed; equal texts of a task come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            fresh = []
            for i, key in enumerate(keys):
                if key not in seen:
                    fresh.append(i)
                    seen.add(key)
            if len(seen) > _SEEN_TEXTS:
                seen.clear()
            part = batch.take(pa.array(fresh, pa.int64()))
            for owner, place, code in seeds.hits(part.column(2).to_pylist()):
                if len(owner):
                    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    offsets = pa.array(np.r_[start, len(owner)].astype(np.int32))
                    rows = part.take(pa.array(owner[start]))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(code.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int64)))]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *lists], names=["k1", "k2", "text", "codes", "places"])

    return texts.mapInArrow(run, "k1 long, k2 long, text string, codes array<long>, places array<long>")


def _passages_of(texts: DataFrame, threshold: float) -> DataFrame:
    """(k1, k2, item, seeds, starts, parts) from (k1, k2, text, wanted: item, n, place): the passages of each pair of text and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                body, by_item = numbered(text), {}
                for w in wanted:
                    by_item.setdefault((w["item"], w["n"]), []).append(w["place"])
                rows = []
                for (item, n), places in by_item.items():
                    cut = passages(np.array(places), n, len(body), threshold)
                    rows.append((item, len(set(places)), [lo for lo, _ in cut], [body[lo:hi].tobytes() for lo, hi in cut]))
                items, seeds, starts, parts = zip(*rows)
                columns = [pa.array([k1] * len(rows)), pa.array([k2] * len(rows)), pa.array(items), pa.array(seeds, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "item", "seeds", "starts", "parts"])

    return texts.select("k1", "k2", "text", "wanted").mapInArrow(run, "k1 long, k2 long, item long, seeds long, starts array<long>, parts array<binary>")


_LEAK_SCHEMA = "k1 long, k2 long, item_id long, score double, word_start long, word_end long, seeds long"


def _aligned(pairs: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k1, k2, item_id, tokens, seeds, starts, parts in zip(*(c.to_pylist() for c in batch.columns)):
                got = best_alignment(np.frombuffer(tokens, np.uint64), starts, [np.frombuffer(p, np.uint64) for p in parts], threshold)
                if got:
                    out.append((k1, k2, item_id, *got, seeds))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["k1", "k2", "item_id", "score", "word_start", "word_end", "seeds"])

    return pairs.select("k1", "k2", "item_id", "tokens", "seeds", "starts", "parts").mapInArrow(run, _LEAK_SCHEMA)


def leaking_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, rare_share: float = RARE_SHARE) -> DataFrame:
    """k1, k2 (the text's key), item_id, score, word_start, word_end, seeds: one row per distinct text and test item, written."""
    spark: SparkSession = docs.sparkSession
    text = F.col(f"`{text_col}`")
    first, second = text_key(text)
    texts = docs.select(first.alias("k1"), second.alias("k2"), text.alias("text"))
    items = materialise(item_table(benchmark), "leaks-items")
    grams = materialise(items.select(F.explode("grams").alias("code"), "size").distinct(), "leaks-grams")
    if grams.isEmpty():
        return spark.createDataFrame([], _LEAK_SCHEMA)
    frequencies = document_frequencies(texts.select("text"), make_filter(grams))
    seeds = materialise(seed_table(items, frequencies, docs.count(), rare_share), "leaks-seeds")
    held = materialise(_texts_with_hits(texts, make_filter(seeds.select("code", "size").distinct())), "leaks-texts")
    # One text may come once from each task that has met it.
    hits = held.select("k1", "k2", F.explode(F.arrays_zip("codes", "places")).alias("hit")).select("k1", "k2", F.col("hit.codes").alias("code"), F.col("hit.places").alias("place")).distinct()
    wanted = hits.join(seeds, "code").groupBy("k1", "k2").agg(F.collect_list(F.struct("item", "n", "place")).alias("wanted"))
    once = held.groupBy("k1", "k2").agg(F.any_value("text").alias("text"))
    pairs = _passages_of(once.join(wanted, ["k1", "k2"]), threshold)
    return materialise(_aligned(pairs.join(items.select("item", "item_id", "tokens"), "item"), threshold), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, rare_share: float = RARE_SHARE) -> DataFrame:
    """One row per document row and test item that it leaks: doc_id, item_id, score, word_start, word_end, seeds.

    Null and empty texts leak nothing and items without a word are in no document; a text of any length is read whole. Repeated
    rows each give their rows, repeated items count once; either table may be empty; other columns are ignored. Items whose id
    is null are left out. Of equally good places in a text the first counts.
    """
    found = leaking_texts(docs, benchmark, text_col, threshold, rare_share)
    first, second = text_key(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), first.alias("k1"), second.alias("k2"))
    return rows.join(found, ["k1", "k2"]).drop("k1", "k2")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, rare_share: float = RARE_SHARE) -> DataFrame:
    """The rows of ``docs`` that leak no test item, as ``leaks`` finds them. All columns stay.

    The keys of leaking texts are a written table: Spark sends it whole where it is small, and shuffles where it isn't.
    """
    found = leaking_texts(docs, benchmark, text_col, threshold, rare_share).select("k1", "k2").distinct()
    first, second = text_key(docs[f"`{text_col}`"])
    return docs.join(found, (first == found["k1"]) & (second == found["k2"]), "left_anti")
