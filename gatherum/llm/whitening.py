"""Embedding whitening by matrix-free block subspace iteration.

The covariance is never formed. Each Spark pass computes Xᵀ(XQ) over the centred rows for a block of ``block`` directions: tasks
hold one batch of rows at a time and give one row for each dimension, which Spark adds up; only a table of dimensions by
directions comes to the driver. There the block is orthonormalised (QR) and rotated to its Ritz vectors (Rayleigh-Ritz); as the
product with a rotated block is the rotated product, this needs no pass. Between two such steps the block runs through a
Chebyshev filter, one pass for each degree, which damps the part of the spectrum below the block's smallest Ritz value: spectra of
embeddings are flat, and plain powers of the covariance would take ten times the passes. It ends when the residuals
|V q - e q| of all components are at most ``TOLERANCE`` times the largest eigenvalue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherum.llm.common import materialise

COMPONENTS = 16
#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Directions of the block for each component, and degree of the filter between two Rayleigh-Ritz steps.
BLOCK, DEGREE = 3, 6
TOLERANCE = 1e-12
#: Passes after which a spectrum counts as one that the block can't separate, which is an error.
MOST_PASSES = 2000
#: Components with an eigenvalue under this share of the trace are noise of rank-deficient data; they aren't returned.
LEAST_SHARE = 1e-9
_ROWS = 4096


def usable(vector: Column) -> Column:
    """The vector is there, has entries, and none is null, NaN or infinite."""
    finite = lambda c: F.abs(c.cast("double")) < float("inf")
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(finite(c) & ~F.isnan(c.cast("double")), F.lit(False))), F.lit(False))


def quantised(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """Entries as longs: floor(scale * c) + offset. Entries beyond 2^40 are cut to it, so that nothing overflows."""
    most = float(1 << 40)
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c.cast("double") * scale))).cast("long") + offset)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(batches: Iterator[pa.RecordBatch], at: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, _ROWS):
            part = batch.slice(low, _ROWS)
            yield part, _matrix(part.column(at), d)


def _summed(fit: DataFrame, d: int, width: int, of_rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of_rows`` (a matrix of ``width`` columns for a block of rows) over all rows of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, 0, d):
            own = of_rows(x)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in total.T]], names=["i", *[f"q{j}" for j in range(width)]])

    parts = fit.select("x").mapInArrow(run, "i int, " + ", ".join(f"q{j} double" for j in range(width)))
    rows = parts.groupBy("i").agg(*[F.sum(f"q{j}").alias(f"q{j}") for j in range(width)]).collect()
    return np.array([r[1:] for r in sorted(rows)])


class Centre:
    """Count and sums of the fit list; rows are centred by exact integers first, so that no digits are lost to the offset."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.sums = n, sums
        self.base = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None where no long holds it."""
        size = ((self.n * self.of(x)) ** 2).sum(axis=1)
        top = self.n * (float(np.abs(x - self.base).max(initial=0)) + 1)
        if top < 2.0**62 and size.max(initial=0) < 2.0**62 and self.n * float(np.abs(x).max(initial=0)) < 2.0**62:
            d = self.n * x - np.array(self.sums, dtype=np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return [e if e < 1 << 63 else None for e in exact]


def principal_components(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, degree: int = DEGREE, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, unit eigenvectors as columns, passes) of the k largest eigenvalues of a symmetric positive matrix.

    ``product(Q)`` gives the matrix times Q, for Q of up to ``block * k`` columns; each call is one pass.
    """
    k = min(k, d)
    b = min(d, block * k)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((d, b)))[0]
    passes = 0
    while True:
        z = product(q)
        passes += 1
        e, u = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        e, u = e[::-1], u[:, ::-1]
        x, vx = q @ u, z @ u
        residual = np.linalg.norm(vx[:, :k] - x[:, :k] * e[:k], axis=0)
        if b == d or e[0] <= 0 or residual.max() <= tolerance * e[0]:
            return e[:k], x[:, :k], passes
        if passes > MOST_PASSES:
            raise RuntimeError(f"residual {residual.max() / e[0]:.1e} of the largest eigenvalue after {passes} passes")
        half = max(e[-1], 1e-3 * e[0]) / 2  # damp [0, 2 * half]
        first = sigma = 1 / max(e[0] / half - 1, 1.0)  # keeps the column of the largest eigenvalue near length one
        before, now = x, sigma * (vx - half * x) / half
        for _ in range(degree - 1):
            v = product(now)
            passes += 1
            after = 1 / (2 / first - sigma)
            before, now, sigma = now, 2 * after / half * (v - half * now) - sigma * after * before, after
        q = np.linalg.qr(now / np.linalg.norm(now, axis=0))[0]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """One row for each usable row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    The fit list is each distinct quantised vector once, so copies don't bend the components; n is its length. Rows whose vector is
    null or empty or holds null or non-finite entries go; where vectors differ in length, those of the most frequent length (the
    longest of equally frequent ones) stay. Repeated rows and null ids stay; other columns are ignored; an empty table, and one whose
    vectors are all equal, gives no rows. Fewer than k components are given where the data have a lower rank. ``deviation`` is null
    where no long can hold it.
    """
    spark = rows.sparkSession
    vector = F.col(f"`{vector_col}`")
    kept = rows.where(usable(vector)).select(F.col(f"`{id_col}`").alias("vec_id"), quantised(vector, scale, offset).alias("x"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    most = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    d = most["d"]
    kept = kept.where(F.size("x") == d)
    fit = materialise(kept.select("x").distinct(), "whitening-fit")
    sums = {r["i"]: int(r["s"]) for r in fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect()}
    centre = Centre(fit.count(), [sums[i] for i in range(d)])
    n = centre.n

    def product(q: np.ndarray) -> np.ndarray:
        return _summed(fit, d, q.shape[1], lambda x: (c := centre.of(x)).T @ (c @ q)) / n

    trace = float(_summed(fit, d, 1, lambda x: (centre.of(x) ** 2).sum(axis=0)[:, None]).sum()) / n
    e, vectors, _ = principal_components(product, d, k)
    real = e > LEAST_SHARE * trace
    e, vectors = e[real], vectors[:, real]
    if not len(e):
        return spark.createDataFrame([], schema)
    to_white = vectors / np.sqrt(e)
    moments = _summed(fit, d, len(e) + 1, lambda x: np.c_[(w := centre.of(x) @ to_white).T @ w, w.sum(axis=0)])
    mean = moments[:, -1] / n
    error = float(np.abs(moments[:, :-1] / n - np.outer(mean, mean) - np.eye(len(e))).max())
    explained = e / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(e)
        for part, x in _blocks(batches, 1, d):
            m = len(x)
            ids = part.column(0).take(pa.array(np.repeat(np.arange(m), c)))
            deviation = pa.array(centre.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), c)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, n)), deviation, pa.array((centre.of(x) @ to_white).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * c, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, schema)
