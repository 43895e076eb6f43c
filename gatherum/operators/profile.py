"""Corpus profiles: text classes, totals, coverage, funnels, duplicates over splits, samples and split constraints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherum.functions import text as T


def text_classes(df: DataFrame, text_col: str, repeats: int = 20, short: int = 5000) -> DataFrame:
    """Adds text_key and text_class: kein_feld (null), leer, platzhalter (a key that often occurs and is short somewhere), text.

    Counts come from one aggregate by key: partial sums keep a hot key from gathering in one task. A key that often occurs is in
    at least ``repeats`` rows, and only such keys are joined back; those in over a thousandth of all rows, a thousand at most, are sent
    to the executors, so that rows that share a key aren't gathered, whatever their texts.
    """
    state = F.when(F.col(text_col).isNull(), "kein_feld").when(F.trim(text_col) == "", "leer")  # before the joins, so that they needn't carry texts
    keyed = df.withColumns({"text_key": T.text_key(F.col(text_col)), "_len": F.length(text_col), "_state": state})
    often = keyed.groupBy("text_key").agg(F.count("*").alias("_n"), F.min("_len").alias("_least")).where((F.col("_n") >= repeats) & (F.col("_least") < short))
    total = df.agg(F.count("*").alias("_total"))
    marked = often.join(F.broadcast(total)).select("text_key", (F.col("_n") * 1000 > F.col("_total")).alias("_hot"))  # one row
    hot = marked.where("_hot").select("text_key", F.lit(True).alias("_often"))
    rare = marked.where("NOT _hot").select("text_key", F.lit(True).alias("_rarer"))
    # Rows with a hot key are settled by the broadcast; they don't take part in the second join, as their key is null there.
    first = keyed.join(F.broadcast(hot), "text_key", "left").withColumn("_key", F.when(F.col("_often").isNull(), F.col("text_key")))
    out = first.join(rare.withColumnRenamed("text_key", "_key"), "_key", "left")
    kind = F.coalesce(F.col("_state"), F.when(F.coalesce("_often", "_rarer"), "platzhalter"), F.lit("text"))
    return out.withColumn("text_class", kind).select(*df.columns, "text_key", "text_class")


def coverage_matrix(features: DataFrame, base: DataFrame, group: str, item: str, feature: str = "feature", least_base: int = 20) -> DataFrame:
    """For each feature: items with it, share of all, groups with a value, groups with half or more, groups with a large base.

    ``base`` has all items with their group, ``features`` (item, feature) pairs; pairs of unknown items don't count.
    """
    sizes = base.select(group, item).distinct().groupBy(group).agg(F.count("*").alias("n_base"))
    have = features.select(item, feature).distinct().join(base.select(group, item).distinct(), item).groupBy(feature, group).agg(F.count("*").alias("n_have"))
    cells = have.join(sizes, group)
    n_all = base.select(item).distinct().agg(F.count("*").alias("n_all"))
    return (
        cells.groupBy(feature)
        .agg(
            F.sum("n_have").alias("n_items"),
            F.count("*").alias("groups_with_value"),
            F.count_if(F.col("n_have") * 2 >= F.col("n_base")).alias("groups_half"),
            F.count_if(F.col("n_base") >= least_base).alias("groups_large_base"),
        )
        .join(F.broadcast(n_all))  # one row
        .withColumn("share", F.col("n_items") / F.col("n_all"))
        .drop("n_all")
    )


def silver_rating(matrix: DataFrame) -> DataFrame:
    """Rates a feature by how many groups have it: breit, teilweise, selten, keine."""
    n, half = F.col("groups_with_value"), F.col("groups_half")
    return matrix.withColumn("rating", F.when((half >= 10) & (half * 2 >= n), "breit").when(n >= 5, "teilweise").when(n >= 1, "selten").otherwise("keine"))


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """Name of the first filter that a row fails; null if it passes all. Each condition says what fails."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, fails in reasons:
        out = out.when(F.coalesce(fails, F.lit(True)), name)
    return out


def cross_split_duplicates(df: DataFrame, key: Column, role: str, ranks: dict[str, int]) -> DataFrame:
    """Rows of keys that occur in two roles or more and whose role isn't the best there: what must leave its split."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col(role)], F.lit(len(ranks)))
    keyed = df.withColumns({"_key": key, "_rank": rank})
    mixed = keyed.groupBy("_key").agg(F.min("_rank").alias("_best"), F.max("_rank").alias("_worst")).where("_best < _worst")
    return keyed.join(mixed, "_key").where("_rank > _best").drop("_key", "_rank", "_best", "_worst")


def inconsistent_mapping(df: DataFrame, label: str, target: str) -> DataFrame:
    """Labels that map to two targets or more; no target counts as one."""
    return df.groupBy(label).agg(F.count_distinct(F.coalesce(F.col(target).cast("string"), F.lit(""))).alias("n_targets")).where("n_targets > 1")


def suppress_small(counts: DataFrame, label: str, n: str = "n", least: int = 5, other: str = "(andere)") -> DataFrame:
    """Labels with few rows become one."""
    return counts.groupBy(F.when(F.col(n) < least, other).otherwise(F.col(label)).alias(label)).agg(F.sum(n).alias(n))


def top_of_group(df: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group, ties by value. Counts combine before the ranking."""
    counted = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), value)
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def latest(df: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of the last row of each key in the given order (end it with a total tie-break)."""
    return df.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def root_allocation(sizes: dict[tuple, int], n: int, least: int = 3) -> dict[tuple, int]:
    """Places for strata: at least ``least`` each, the rest by square roots with largest remainders, capped by size."""
    names = sorted(sizes)
    size = np.array([sizes[s] for s in names], dtype=np.int64)
    places = np.minimum(size, least)
    while (open_places := n - int(places.sum())) > 0 and (room := size - places).any():
        root = np.where(room > 0, np.sqrt(size), 0.0)
        exact = open_places * root / root.sum()
        step = np.minimum(exact.astype(np.int64), room)
        if not step.any():
            best = np.argsort(np.where(room > 0, exact.astype(np.int64) - exact, 1.0), kind="stable")
            step[best[: min(open_places, int((room > 0).sum()))]] = 1
        places += step
    return dict(zip(names, places.tolist()))


def hash_order(seed: str, column: str) -> Column:
    """A rank key that is the same on every engine."""
    return F.sha2(F.concat_ws(":", F.lit(seed), F.col(column).cast("string")).cast("binary"), 256)


def stratified_sample(df: DataFrame, strata: list[str], item: str, n: int, seed: str = "42", least: int = 3) -> DataFrame:
    """A sample of about ``n`` rows by ``root_allocation``; in each stratum the first rows in hash order.

    Only the sizes of the strata reach the driver.
    """
    sizes = {tuple(r[s] for s in strata): r["n"] for r in df.groupBy(*strata).agg(F.count("*").alias("n")).collect()}
    quota = root_allocation({tuple("" if v is None else str(v) for v in k): v for k, v in sizes.items()}, n, least)
    if not quota:
        return df.limit(0)
    rows = [(*map(str, k), q) for k, q in quota.items()]
    table = df.sparkSession.createDataFrame(rows, ", ".join(f"_s{i} string" for i in range(len(strata))) + ", _quota int")
    on = [F.coalesce(F.col(s).cast("string"), F.lit("")) == F.col(f"_s{i}") for i, s in enumerate(strata)]
    w = Window.partitionBy(*strata).orderBy(hash_order(seed, item), item)
    ranked = df.withColumn("_place", F.row_number().over(w))
    return ranked.join(table, on).where("_place <= _quota").select(*df.columns)


def greedy_folds(sizes: list[tuple[str, int]], folds: int) -> dict[str, int]:
    """Groups, largest first (ties by name), each into the fold with the fewest rows (ties: the first). Folds count from 1."""
    load, out = [0] * folds, {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        k = min(range(folds), key=lambda i: (load[i], i))
        out[name], load[k] = k + 1, load[k] + n
    return out


def fold_table(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, n, fold) by ``greedy_folds``; the groups' sizes reach the driver, so groups should be few."""
    sizes = [(r[group], r["n"]) for r in df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).collect()]
    fold = greedy_folds(sizes, folds)
    return df.sparkSession.createDataFrame([(g, n, fold[g]) for g, n in sizes], f"{group} string, n long, fold int")


def split_violations(split: DataFrame, group: str, role: str, level: str, needed: list[str], roles: list[str]) -> DataFrame:
    """Violations of a split by groups, one row each (rule, what): a group without a known role, a group with two roles,
    a role without groups, a role that lacks a needed level."""
    known = split.select(group, role, level).distinct()
    no_role = known.where(F.col(role).isNull() | ~F.col(role).isin(roles)).select(F.lit("R1_no_role").alias("rule"), F.col(group).cast("string").alias("what"))
    two = known.groupBy(group).agg(F.count_distinct(role).alias("n")).where("n > 1").select(F.lit("R2_two_roles").alias("rule"), F.col(group).cast("string").alias("what"))
    want = split.sparkSession.createDataFrame([(r, x) for r in roles for x in needed], f"{role} string, {level} string")
    lacking = want.join(known.select(role, level).distinct(), [role, level], "left_anti").select(F.lit("R4_level_missing").alias("rule"), F.concat_ws(":", role, level).alias("what"))
    return no_role.unionByName(two).unionByName(lacking)


def set_state(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, kinds): the distinct values of each key, sorted; for columns of few values."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("kinds"))
