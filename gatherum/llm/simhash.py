"""SimHash near-duplicates by bit-sliced comparison.

Documents become 64-bit fingerprints; equal fingerprints collapse into one class before anything is compared. Classes
meet in the buckets of a block permutation index: 64 bits are cut into ``radius + 3`` blocks, and two fingerprints that
differ in at most ``radius`` bits agree on three blocks at least, so each choice of three blocks is one exact table with
keys of about 32 bits. In a bucket, fingerprints are stored as bit planes; the XOR of planes is added to all distances of a
block of lanes at once by carry-save bitwise counters, and words whose 64 lanes all exceed the radius are abandoned.
A bucket emits a spanning forest of its links (fewer rows than it has members), never its pairs; a connected component
search over tables in the shared folder joins the forests. A bucket holds distinct fingerprints only, so copies of one
document, however many, count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherum.llm.common import join_facts, materialise
from gatherum.llm.components import connected_components

SEED = 42
RADIUS = 3
SHINGLE_WORDS = 3
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Runs up to this length compare all their pairs as lanes; longer ones compare queries with planes of the whole run.
_SMALL_RUN = 48
_BUFFER_ROWS = 200_000
#: Fingerprints of a bucket that one task compares.
MOST_IN_BUCKET = 16_384


def fingerprint(text: str | None, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned SimHash of the ``width``-word shingles (repeats count) of a text with A-Z lower-cased; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    if len(words) < width:
        shingles: Iterator[bytes] = iter((b" ".join(words),))
        total = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
        total = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8", count=total)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, total, 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: doc_id and ``fp``, the fingerprint as a signed 64-bit integer. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of unsigned 64-bit values: row b holds bit b of all values, 64 lanes to a word."""
    padded = np.zeros(-(-len(values) // 64) * 64, dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within_radius(xor_plane: Callable[[int, np.ndarray | None], np.ndarray], words: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes at a distance of at most ``radius``: (indices of live words, their bits).

    ``xor_plane(b, live)`` gives the XOR of plane b for the live words (None: all). Distances are carry-save counters of
    just enough bits for the radius; ``over`` marks lanes whose counter has run past them.
    """
    width = max(1, radius.bit_length())
    counters = [np.zeros(words, dtype=np.uint64) for _ in range(width)]
    over = np.zeros(words, dtype=np.uint64)
    live: np.ndarray | None = None
    for b in range(64):
        carry = xor_plane(b, live)
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7 and b < 63:
            keep = np.flatnonzero(over != _ALL)
            if len(keep) < 0.7 * len(over):
                live = keep if live is None else live[keep]
                counters, over = [c[keep] for c in counters], over[keep]
                if not len(keep):
                    return live, over
    beyond, equal = np.zeros_like(over), np.full_like(over, _ALL)  # counter > radius, from the highest bit down
    for k in reversed(range(width)):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            beyond |= equal & counters[k]
            equal &= ~counters[k]
    return (np.arange(words) if live is None else live), ~(over | beyond)


def _lanes(words: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, lane) of each set bit."""
    some = np.flatnonzero(bits)
    row, lane = np.nonzero(np.unpackbits(bits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return words[some][row], lane


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hook the larger root of each linked pair to the smaller one until all pairs agree."""
    while len(a):
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def links_of_pairs(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs (x[i], y[i]) are within the radius; the pairs are the lanes."""
    planes = _planes(x ^ y)
    words, bits = within_radius(lambda b, live: planes[b] if live is None else planes[b][live], planes.shape[1], radius)
    word, lane = _lanes(words, bits)
    at = word * 64 + lane
    return np.sort(at[at < len(x)])


def links_of_run(values: np.ndarray, parent: np.ndarray, radius: int, queries: int = 512) -> None:
    """Union all members of one long run that are within the radius; compares blocks of queries with the run's planes."""
    planes, n = _planes(values), len(values)
    width = planes.shape[1]
    for start in range(0, n, queries):
        q = values[start : start + queries]
        first = start // 64  # only lanes from the first query's word on: each pair once
        part = planes[:, first:]
        span = width - first
        masks = np.where((q[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), _ALL, np.uint64(0))

        def xor_plane(b: int, live: np.ndarray | None) -> np.ndarray:
            if live is None:
                return (masks[b][:, None] ^ part[b][None, :]).ravel()
            return masks[b][live // span] ^ part[b][live % span]

        words, bits = within_radius(xor_plane, len(q) * span, radius)
        word, lane = _lanes(words, bits)
        i, j = start + word // span, (first + word % span) * 64 + lane
        real = (j < n) & (i < j)
        _union(parent, i[real], j[real])


def bucket_links(key: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """Parent of each row (rows are sorted by key): the first row of its component within its bucket."""
    n = len(key)
    parent = np.arange(n)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, int)
    size = np.diff(np.r_[start, n])
    small = (size > 1) & (size <= _SMALL_RUN)
    rows = np.flatnonzero(np.repeat(small, size))
    end = np.repeat(start + size, size)
    for lag in range(1, int(size[small].max()) if small.any() else 0):
        rows = rows[rows + lag < end[rows]]
        hit = rows[links_of_pairs(fp[rows], fp[rows + lag], radius)]
        _union(parent, hit, hit + lag)
    for s, m in zip(start[size > _SMALL_RUN], size[size > _SMALL_RUN]):
        own = np.arange(m)
        links_of_run(fp[s : s + m], own, radius)
        parent[s : s + m] = s + own
    while not np.array_equal(parent[parent], parent):
        parent = parent[parent]
    return parent


def _table_masks(radius: int) -> list[int]:
    blocks = radius + 3
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _runs_of_links(radius: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of rows (key, fp, id) that are sorted by key: (src, dst, key, fp). A bucket of more than ``most`` rows is passed on as it came, without dst.

    No more than a buffer and one bucket of ``most`` rows are held.
    """

    def links(key: np.ndarray, fp: np.ndarray, ident: np.ndarray) -> pa.RecordBatch:
        parent = bucket_links(key, fp.view(np.uint64), radius)
        at = np.flatnonzero(parent != np.arange(len(parent)))
        none = pa.nulls(len(at), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ident[at]), pa.array(ident[parent[at]]), none, none], names=["src", "dst", "key", "fp"])

    def passed(key: np.ndarray, fp: np.ndarray, ident: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ident), pa.nulls(len(ident), pa.int64()), pa.array(key), pa.array(fp)], names=["src", "dst", "key", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        large, fresh = None, 0  # large: the key of the bucket that is being passed on

        def settled(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, large
            key, fp, ident = (np.concatenate(x) for x in zip(*held))
            if large is not None:
                cut = int(np.searchsorted(key, large, side="right"))
                if cut:
                    yield passed(key[:cut], fp[:cut], ident[:cut])
                key, fp, ident = key[cut:], fp[cut:], ident[cut:]
                large = large if not len(key) else None
            open_from = len(key) if last or not len(key) else int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            start = np.flatnonzero(np.r_[True, key[1:open_from] != key[: open_from - 1]]) if open_from else np.zeros(0, int)
            size = np.diff(np.r_[start, open_from])
            over = np.repeat(size > most, size)
            if over.any():
                yield passed(key[:open_from][over], fp[:open_from][over], ident[:open_from][over])
            if not over.all():
                yield links(key[:open_from][~over], fp[:open_from][~over], ident[:open_from][~over])
            key, fp, ident = key[open_from:], fp[open_from:], ident[open_from:]
            if len(key) > most:
                large = int(key[0])
                yield passed(key, fp, ident)
                key, fp, ident = key[:0], fp[:0], ident[:0]
            held = [(key, fp, ident)]

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in range(3)))
            fresh += batch.num_rows
            if fresh >= _BUFFER_ROWS:
                yield from settled(False)
                fresh = 0
        if held:
            yield from settled(True)

    return run


def near_links(classes: DataFrame, radius: int = RADIUS, most: int = MOST_IN_BUCKET) -> DataFrame:
    """Spanning links (src > dst) between classes (fp, id) whose fingerprints differ in at most ``radius`` bits; a written table.

    Buckets of more than ``most`` fingerprints are dealt to blocks by a hash, and each pair of blocks is compared by a task of its own.
    """
    schema = "src long, dst long, key long, fp long"
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(_table_masks(radius))])
    sorted_rows = lambda rows: rows.repartition("key").sortWithinPartitions("key", "id")
    found = materialise(sorted_rows(classes.select(F.explode(keys).alias("key"), "fp", "id")).mapInArrow(_runs_of_links(radius, most), schema).distinct(), "simhash-links")
    links, large = found.where("dst is not null").select("src", "dst"), found.where("dst is null").select("key", "fp", F.col("src").alias("id"))
    if large.isEmpty():
        return links
    blocks = F.ceil(F.col("n") * 2 / most).cast("int")
    dealt = join_facts(large, large.groupBy("key").agg(F.count("*").alias("n")), "key", "n", large.count()).withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("fp"), blocks).cast("int")})
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least("own", j), F.greatest("own", j)))).alias("key")
    again = sorted_rows(dealt.select(pair, "fp", "id")).mapInArrow(_runs_of_links(radius, 1 << 62), schema).select("src", "dst")
    return materialise(links.unionByName(again).distinct(), "simhash-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Null and empty texts have fingerprint zero and link like any other; texts of any length are read whole; repeated rows stay; a null
    doc_id never becomes a component_id unless its whole class has none; an empty table gives no rows; other columns are ignored.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "simhash-classes")
    component = connected_components(near_links(classes.where("id is not null").select("fp", "id"), radius))
    named = materialise(classes.join(component, classes["id"] == component["node"], "left").select("fp", "n", F.coalesce("component", "id").alias("component_id")), "simhash-named")
    # Copies of one document share a fingerprint, however many they are.
    return join_facts(prints, named, "fp", "n", prints.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component: the one with the smallest id (a null id is the largest), whatever ids repeat."""
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(numbered, "simhash-docs")
    component = near_duplicates(rows.select("row", F.col("doc")[text_col].alias("text")), "row", "text", width, radius).select(F.col("doc_id").alias("row"), "component_id")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    kept = rows.select("row", F.col("doc")[id_col].alias("id")).join(component, "row").groupBy("component_id").agg(F.min(rank).alias("rank")).select("rank.row")
    return rows.join(kept, "row", "left_semi").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
