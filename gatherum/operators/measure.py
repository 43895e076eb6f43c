"""Measures: outcomes against references, calibration, thresholds, errors of probabilities, intervals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gatherum.functions import numbers as N


def outcome(value: Column, references: Column) -> Column:
    """no_reference (no or an empty set), not_found, equal or different. An empty value equals nothing."""
    none = references.isNull() | (F.size(references) == 0)
    missing = F.coalesce(value.cast("string"), F.lit("")) == ""
    return F.when(none, "no_reference").when(missing, "not_found").when(F.array_contains(references, value), "equal").otherwise("different")


def cells(df: DataFrame, dims: list[str], code: str = "outcome") -> DataFrame:
    """Counts and rates by every dimension alone and in total: precision over found, recall and coverage over all with a reference."""
    sets = df.groupingSets([[d] for d in dims] + [[]], *dims)
    out = sets.agg(*[F.count_if(F.col(code) == c).alias(f"n_{c}") for c in ("equal", "different", "not_found", "no_reference")], F.grouping_id().alias("cell"))
    found, base = F.col("n_equal") + F.col("n_different"), F.col("n_equal") + F.col("n_different") + F.col("n_not_found")
    return out.withColumns({"precision": F.when(found > 0, F.col("n_equal") / found), "recall": F.when(base > 0, F.col("n_equal") / base), "coverage": F.when(base > 0, found / base)})


def calibration(df: DataFrame, tier: list[str], fold: str, correct: str) -> DataFrame:
    """(tier, fold, k, n, p, p_without): Jeffreys means of each tier over all rows, and over those outside the fold."""
    by = df.groupBy(*tier, fold).agg(F.sum(F.col(correct).cast("long")).alias("k_fold"), F.count("*").alias("n_fold"))
    w = Window.partitionBy(*tier)
    both = by.withColumns({"k": F.sum("k_fold").over(w), "n": F.sum("n_fold").over(w)})
    return both.withColumns({"p": N.clip(N.jeffreys_mean(F.col("k"), F.col("n"))), "p_without": N.clip(N.jeffreys_mean(F.col("k") - F.col("k_fold"), F.col("n") - F.col("n_fold")))})


def threshold(df: DataFrame, p: str, correct: str, grid: list[float], accuracy: tuple[int, int] = (95, 100), coverage: tuple[int, int] = (1, 2)) -> DataFrame:
    """(a, n, k, total, meets, chosen) for each threshold: enough accuracy and coverage, in whole numbers; the smallest such is chosen.

    One pass over the data: each row counts once per threshold it reaches, as columns, not rows.
    """
    sums = df.agg(F.count("*").alias("total"), *[x for i, a in enumerate(grid) for x in (F.count_if(F.col(p) >= a).alias(f"n{i}"), F.count_if((F.col(p) >= a) & F.col(correct)).alias(f"k{i}"))])
    rows = sums.select("total", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("k")) for i, a in enumerate(grid)])).alias("r")).select("r.*", "total")
    meets = (F.col("n") > 0) & (F.col("k") * accuracy[1] >= F.col("n") * accuracy[0]) & (F.col("n") * coverage[1] >= F.col("total") * coverage[0])
    return rows.withColumn("meets", meets).withColumn("chosen", F.min(F.when(meets, F.col("a"))).over(Window.partitionBy("total")).eqNullSafe(F.col("a")))


def reliability(df: DataFrame, p: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, share_correct) over bins of equal width."""
    return df.groupBy(N.probability_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(correct).cast("double")).alias("share_correct"))


def expected_calibration_error(df: DataFrame, p: str, correct: str, bins: int = 10) -> DataFrame:
    table = reliability(df, p, correct, bins)
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share_correct"))) / F.sum("n")).alias("ece"))


def ece_equal_mass(df: DataFrame, p: str, correct: str, order: str, bins: int = 10) -> DataFrame:
    """Calibration error over bins of equal size; larger bins first, ties of p by ``order``.

    Ranks come from a global sort of (p, order), as a rank within a range partition plus the sizes of the ranges before it
    would; the single-partition window is acceptable for measure sets of labelled rows only.
    """
    ranked = df.withColumn("_bin", F.ntile(bins).over(Window.orderBy(p, order)))
    table = ranked.groupBy("_bin").agg(F.count("*").alias("n"), F.avg(p).alias("a"), F.avg(F.col(correct).cast("double")).alias("b"))
    return table.agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("b"))) / F.sum("n")).alias("ece_mass"))


def probability_errors(df: DataFrame, p: str, correct: str) -> DataFrame:
    """(n, brier, nll, wrong_at_99): mean squared error, negative log likelihood, wrong ones with p of 0.99 or more."""
    y = F.col(correct).cast("double")
    q = N.clip(F.col(p), 1e-6, 1 - 1e-6)
    return df.agg(
        F.count("*").alias("n"),
        F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"),
        F.avg(-(y * F.ln(q) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - q))).alias("nll"),
        F.count_if((F.col(p) >= 0.99) & ~F.col(correct)).alias("wrong_at_99"),
    )


def coverage_curve(df: DataFrame, p: str, correct: str, grid: list[float]) -> DataFrame:
    """(a, coverage, error) of keeping rows with p of a or more."""
    rows = threshold(df, p, correct, grid)
    return rows.select("a", (F.col("n") / F.col("total")).alias("coverage"), F.when(F.col("n") > 0, F.lit(1.0) - F.col("k") / F.col("n")).alias("error"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def beta_quantile(a: float, b: float, q: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(a, b, mid) < q else (low, mid)
    return (low + high) / 2


@F.pandas_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
def jeffreys_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """90 % interval of a share by Jeffreys' prior."""
    rows = [(beta_quantile(x + 0.5, m - x + 0.5, 0.05), beta_quantile(x + 0.5, m - x + 0.5, 0.95)) for x, m in zip(k, n)]
    return pd.DataFrame(rows, columns=["low", "high"])


def cluster_bootstrap(df: DataFrame, group: str, correct: str, draws: int = 2000, seed: int = 20261013) -> DataFrame:
    """(n_groups, k, n, low, high): 90 % interval of the share correct when whole groups are drawn anew.

    Groups meet the driver as one sum each; a share of a draw is a sum of group sums.
    """
    sums = df.groupBy(group).agg(F.sum(F.col(correct).cast("long")).alias("k"), F.count("*").alias("n")).orderBy(group).toPandas()
    k, n = sums["k"].to_numpy(dtype=float), sums["n"].to_numpy(dtype=float)
    if not len(k):
        return df.sparkSession.createDataFrame([], "n_groups long, k long, n long, low double, high double")
    drawn = np.random.default_rng(seed).integers(0, len(k), size=(draws, len(k)))
    shares = k[drawn].sum(axis=1) / n[drawn].sum(axis=1)
    return df.sparkSession.createDataFrame([(len(k), int(k.sum()), int(n.sum()), float(np.quantile(shares, 0.05)), float(np.quantile(shares, 0.95)))], "n_groups long, k long, n long, low double, high double")


def prf(df: DataFrame, hits: str, hyp: str, ref: str) -> DataFrame:
    """Micro-averaged precision, recall and F1 of counters summed over documents; without rows on a side that share is 1."""
    s = df.agg(F.sum(hits).alias("tp"), F.sum(hyp).alias("n_hyp"), F.sum(ref).alias("n_ref"))
    p = F.when(F.col("n_hyp") > 0, F.col("tp") / F.col("n_hyp")).otherwise(1.0)
    r = F.when(F.col("n_ref") > 0, F.col("tp") / F.col("n_ref")).otherwise(1.0)
    return s.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall) of each class; the mean recall is the balanced accuracy."""
    t = df.groupBy(F.col(truth).alias("label")).agg(F.count_if(F.col(truth).eqNullSafe(F.col(predicted))).alias("tp"), F.count("*").alias("n_true"))
    p = df.groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("n_pred"))
    both = t.join(p, "label", "full_outer").fillna(0, ["tp", "n_true", "n_pred"])
    return both.select("label", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).alias("precision"), F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).alias("recall"))


def decision(rule: Column, model: Column, held_out: Column) -> list[Column]:
    """decided_by (rule, model, none or refused) and value: a certain rule's value goes first; nothing is decided for what is held out."""
    refused = F.coalesce(held_out, F.lit(True))
    by = F.when(refused, "refused").when(rule.isNotNull(), "rule").when(model.isNotNull(), "model").otherwise("none")
    return [by.alias("decided_by"), F.when(~refused, F.coalesce(rule, model)).alias("value")]


def tier_calibration(df: DataFrame, keys: list[str], correct: str, least: int = 20, certain: float = 0.9) -> DataFrame:
    """(keys, k, n, p, certain): the mean share correct of each tier by Jeffreys' prior, within bounds, and whether it is certain: enough rows and a share of ``certain`` or more."""
    sums = df.groupBy(*keys).agg(F.count_if(F.col(correct)).alias("k"), F.count("*").alias("n"))
    mean = (F.col("k") + 0.5) / (F.col("n") + 1.0)
    return sums.select(*keys, "k", "n", N.clip(mean, 0.005, 0.995).alias("p"), ((F.col("n") >= least) & (mean >= certain)).alias("certain"))
