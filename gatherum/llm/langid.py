"""Language identification with hyperdimensional profiles.

Every letter class has a random bipolar vector. An n-gram vector binds (multiplies) the vectors of its letters, each
permuted (rotated) by its place; a text bundles (adds) the vectors of its n-grams, repeats included; a language prototype
bundles those of its training texts. A document takes the language whose prototype has the largest cosine.
Bundling is linear, so counts of n-grams are gathered first and meet the n-gram vectors once per distinct n-gram.
Letters of all scripts count; the text is read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatherum.llm.common import slices

DIMENSIONS = 1024
SEED = 20240229
#: Documents that the prototypes are learnt from at most: for each language the same share of this, taken by a hash of the id.
TRAIN_LIMIT = 50_000
#: Documents that a floor of scores is learnt from: about so many at most, so many at least.
FLOOR_LIMIT, FLOOR_ROWS = 5_000, 100
#: So many trigrams say nothing about a language: the floor is 0 up to here and rises to its share with longer texts.
SHORT = 6
UNKNOWN = "und"
#: Classes of letters: a to z one each, all other letters dealt to the rest.
_SYMBOLS = 256
#: Unicode has no letters from here on.
_LETTERS_END = 0x40000
#: Characters of a piece of text whose n-grams are counted at once; pieces overlap so that none is lost.
_PIECE = 1 << 20
#: Languages whose sums a worker holds at once.
_HELD = 256


def symbol_of(ch: str) -> int:
    """The class of a character: 0 for what is no letter, 1 to 26 for a to z, then that of a hash of its lower case."""
    if not ch.isalpha():
        return 0
    low = ord(ch.lower()[0])
    return low - 96 if 97 <= low <= 122 else 27 + (low * 2_654_435_761 >> 7) % (_SYMBOLS - 27)


_tables: dict[str, np.ndarray] = {}


def letter_bits() -> np.ndarray:
    """The random vectors of the letter classes as sign bits (1 for -1)."""
    return np.random.default_rng(SEED).integers(0, 2, size=(_SYMBOLS, DIMENSIONS), dtype=np.uint8)


def _table(name: str) -> np.ndarray:
    """``symbols`` of all code points; ``first``, ``second``, ``third``: packed sign bits of the letters permuted by their place.

    With sign bits binding is an exclusive or.
    """
    if name not in _tables:
        if name == "symbols":
            _tables[name] = np.array([symbol_of(chr(c)) for c in range(_LETTERS_END)], dtype=np.uint8)
        else:
            for turn, place in ((2, "first"), (1, "second"), (0, "third")):
                _tables[place] = np.packbits(np.roll(letter_bits(), turn, axis=1), axis=1)
    return _tables[name]


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their counts."""
    values, at = np.unique(codes, return_inverse=True)
    return values, np.bincount(at, weights=counts, minlength=len(values)).astype(np.int64)


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the letter trigrams of a text, without those that are no letters but for the border of a word."""
    none = np.zeros(0, dtype=np.int64)
    if not text:
        return none, none
    table, found = _table("symbols"), []
    for at in range(0, len(text), _PIECE):
        part = " " * (at == 0) + text[max(0, at - 2) : at + _PIECE] + " " * (at + _PIECE >= len(text))
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbol = table[np.minimum(points, _LETTERS_END - 1)]  # the last code point of the table is no letter
        keep = (symbol[1:] != 0) | (symbol[:-1] != 0)  # one gap between words
        symbol = symbol[np.r_[True, keep]].astype(np.int32)
        gram = (symbol[:-2] * _SYMBOLS + symbol[1:-1]) * _SYMBOLS + symbol[2:]
        found.append(np.unique(gram[symbol[1:-1] != 0], return_counts=True))
    return found[0] if len(found) == 1 else _summed(*map(np.concatenate, zip(*found)))


def encode(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bundle of n-gram vectors, each bound when it is needed."""
    first, second, third, out = _table("first"), _table("second"), _table("third"), np.zeros(DIMENSIONS, dtype=np.float64)
    for at in range(0, len(codes), 1024):
        part = codes[at : at + 1024]
        bound = first[part // _SYMBOLS**2]
        bound ^= second[part // _SYMBOLS % _SYMBOLS]
        bound ^= third[part % _SYMBOLS]
        out -= counts[at : at + 1024].astype(np.float32) @ np.unpackbits(bound, axis=1).astype(np.float32)
    return 2 * out + counts.sum()


def _bundles(rows: DataFrame) -> DataFrame:
    """(lang, place, value): the bundle of all texts (column text) of each language; whole numbers, so sums don't depend on their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["lang", "bundle"])
            sums.clear()
            return out

        for batch in slices(batches):
            grams: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams.setdefault(lang, []).append(trigram_counts(text))
            for lang, found in grams.items():
                codes, counts = _summed(*map(np.concatenate, zip(*found)))
                sums[lang] = sums.get(lang, 0) + np.rint(encode(codes, counts)).astype(np.int64)
                if len(sums) >= _HELD:
                    yield given()
        if sums:
            yield given()

    parts = rows.select("text", "lang").mapInArrow(run, "lang string, bundle array<long>")
    return parts.select("lang", F.posexplode("bundle").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))


def hash_below(n: int, total: int) -> int:
    """The bound below which a signed 64-bit hash lies for a share of n / total (less than one) of all ids, however large ``total`` is."""
    return (n << 64) // total - (1 << 63)


def sample(rows: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` of the rows (doc_id, text, lang) at most: languages with more rows than an even share of it are cut to that by a hash of the id."""
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    quota = max(1, limit // max(1, len(sizes)))
    bounds = [F.lit(x) for lang, n in sizes.items() if n > quota for x in (lang, hash_below(quota, n))]
    return rows.where(F.coalesce(F.xxhash64("doc_id") < F.get(F.array(F.create_map(*bounds)), F.lit(0))[F.col("lang")], F.lit(True))) if bounds else rows


def _labelled(rows: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")


def learn(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = TRAIN_LIMIT) -> dict[str, np.ndarray]:
    """Unit prototypes by language from labelled rows (null texts and labels are left out).

    At most about ``limit`` documents are used, of each language the same number where it has so many, by a hash of the id. Bundles are
    added up on the executors; DIMENSIONS numbers a language come to the driver.
    """
    table = _bundles(sample(_labelled(rows, id_col, text_col, lang_col), limit)).toArrow()
    langs, places, values = (table.column(k).to_numpy() for k in range(3))
    got: dict[str, np.ndarray] = {}
    for lang in sorted(set(langs)):
        v = np.zeros(DIMENSIONS)
        v[places[langs == lang]] = values[langs == lang]
        if v.any():
            got[str(lang)] = (v / float(np.linalg.norm(v))).astype(np.float32)
    return got


class Predictor:
    """Prototypes as a matrix; travels to the executors (languages times DIMENSIONS floats)."""

    def __init__(self, prototypes: dict[str, np.ndarray]):
        self.names = sorted(prototypes)
        self.matrix = np.stack([prototypes[x] for x in self.names]).astype(np.float32) if self.names else np.zeros((0, DIMENSIONS), np.float32)

    def cosines(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of trigrams (repeats count up to twice the distinct ones), and the cosine with each prototype (none where nothing can be compared)."""
        codes, counts = trigram_counts(text)
        if not len(codes) or not len(self.matrix):
            return 0, np.zeros(0, np.float32)
        v = encode(codes, counts)
        return min(int(counts.sum()), 2 * len(codes)), self.matrix @ v.astype(np.float32) / max(float(np.linalg.norm(v)), 1e-9)

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.named(self.cosines(text)[1])

    def named(self, cosine: np.ndarray) -> tuple[str, float]:
        if not len(cosine):
            return UNKNOWN, 0.0
        best = int(np.argmax(cosine))
        return self.names[best], float(np.clip(cosine[best], 0.0, 1.0))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (cosine with the best prototype, 0 to 1).

    Null texts, texts without a letter, and all texts where nothing was learnt give ``und`` with score 0. Of languages with
    equal cosines the first by name wins. Only the text is read, of any length. Repeated rows each give theirs, an empty table none.
    """
    one = Predictor(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [one(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


class Floor(NamedTuple):
    """Least score of a text of n trigrams: ``share`` of sqrt(n / (n + half)), which clean texts of that length have, less for short ones."""

    half: float = 0.0
    share: float = 0.0

    def __call__(self, n: int) -> float:
        return self.share * (n / (n + self.half)) ** 0.5 * max(0.0, 1 - SHORT / n) if n else 0.0


def learn_floor(rows: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = FLOOR_LIMIT) -> Floor:
    """The floor of labelled rows, from a sample of about ``limit`` by a hash of the id.

    ``half`` is the median over the rows that are closest to their own prototype; 99.9 % of them reach ``share`` with it. No floor is
    learnt from fewer than ``FLOOR_ROWS`` rows or a single language.
    """
    if len(prototypes) < 2:
        return Floor()
    rows = sample(_labelled(rows, id_col, text_col, lang_col).where(F.col("lang").isin(sorted(prototypes))), limit)
    one = Predictor(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, cosine = one.cosines(text)
                if n:
                    at = one.names.index(lang)
                    got.append((n, float(cosine[at]), float(np.delete(cosine, at).max())))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.float64()) for k in range(3)], names=["n", "own", "other"])

    found = rows.select("text", "lang").mapInArrow(run, "n double, own double, other double").toArrow()
    n, own, other = (found.column(k).to_numpy() for k in range(3))
    clear = (own > other) & (own > 0)
    if clear.sum() < FLOOR_ROWS:
        return Floor()
    n, own = n[clear], own[clear]
    half = float(np.median(n * np.maximum(1 / own**2 - 1, 0)))
    return Floor(half, 0.9999 * float(np.quantile(own / np.sqrt(n / (n + half)), 0.001, method="lower")))


def drop_unknown(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", least: float = 0.0, floor: Floor | None = None) -> DataFrame:
    """The rows of ``docs`` with a language (not ``und``), a score of at least ``least`` and, where given, of the floor for their length.

    All columns stay; no shuffle. Very short clean texts have low cosines, so ``least`` is 0 unless the caller wants one.
    """
    one, at, floor = Predictor(prototypes), docs.columns.index(text_col), floor or Floor()
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names may hold dots

    def known(text: str | None) -> bool:
        n, cosine = one.cosines(text)
        name, score = one.named(cosine)
        return name != UNKNOWN and score >= max(least, floor(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([known(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def held_out(id_col: str = "doc_id"):
    """True for the documents that nothing is learnt from; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def identify(spark: SparkSession, docs: DataFrame, training: DataFrame | None = None, limit: int = TRAIN_LIMIT) -> DataFrame:
    """Learn from the rows of ``training`` (else ``docs``) that aren't held out, then predict all ``docs``."""
    source = docs if training is None else training
    prototypes = learn(source.where(~held_out()), limit=limit)
    return predict(docs, prototypes)
