"""Numbers, vectors and boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_P, MOST_P = 0.005, 0.995


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda e: e / total(shifted))


def log_sum_exp(logits: Column) -> Column:
    return F.array_max(logits) + F.ln(total(F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clip(p: Column, low: float = LEAST_P, high: float = MOST_P) -> Column:
    return F.least(F.greatest(p, F.lit(low)), F.lit(high))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (F.lit(1.0) - q))


def as_written(p: Column) -> Column:
    """A probability as records state it: within bounds, four decimals."""
    return F.bround(clip(p), 4)


def jeffreys_mean(k: Column, n: Column) -> Column:
    return (k + F.lit(0.5)) / (n + F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def linear_head(x: Column, weights: list[float], bias: float) -> Column:
    """Affine score of a vector with fixed weights."""
    return dot(x, F.array(*map(F.lit, weights))) + F.lit(bias)


def spread(p: Column, weights: Column) -> Column:
    """What a probability leaves, over other options by their weights (evenly if all are 0)."""
    w = total(weights)
    return F.transform(weights, lambda x: (F.lit(1.0) - p) * F.when(w > 0, x / w).otherwise(F.lit(1.0) / F.size(weights)))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [x0, y0, x1, y1]."""
    at = lambda c, i: F.get(c, F.lit(i))
    span = lambda i: F.greatest(F.least(at(a, i + 2), at(b, i + 2)) - F.greatest(at(a, i), at(b, i)), F.lit(0.0))
    area = lambda c: (at(c, 2) - at(c, 0)) * (at(c, 3) - at(c, 1))
    common = span(0) * span(1)
    return common / (area(a) + area(b) - common)


def set_iou(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def lower_quantile(sorted_values: Column, q: float) -> Column:
    """The value at place min(n - 1, int(q * n)) of sorted values; 0 without values."""
    n = F.size(sorted_values)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.get(sorted_values, F.least(n - 1, F.floor(n * q).cast("int"))))


def log_bin(x: Column) -> Column:
    """Quarter decades; -99 stands for 0."""
    return F.when(x <= 0, F.lit(-99.0)).otherwise(F.floor(F.log10(x) * 4) / 4)


def probability_bin(p: Column, bins: int = 10) -> Column:
    """Number of the bin [b / bins, (b + 1) / bins) by the edges as they are written; the last holds 1."""
    out = F.lit(bins - 1)
    for b in reversed(range(bins - 1)):
        out = F.when(p < (b + 1) / bins, F.lit(b)).otherwise(out)
    return out
