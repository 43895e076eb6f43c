"""Checks of graphs and schemas: shapes, label rules, relaxed requirements, tensors, rule files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P_MIN, P_MAX = 0.005, 0.995


def shape_violations(quads: DataFrame, shapes: DataFrame) -> DataFrame:
    """(s, path, reason): nodes of a class that break its shapes.

    ``shapes``: target (class), path, least, most (numbers of values), kind (iri, blank or literal), datatype, pattern; a null asks for nothing. A value counts once,
    in however many graphs it stands.
    """
    rdf_type = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    nodes = quads.where((F.col("p") == rdf_type) & (F.col("o_kind") == "iri")).select("s", F.col("o").alias("target")).distinct()
    wanted = nodes.join(F.broadcast(shapes), "target")  # shapes are a schema: rows of a class and a path
    values = quads.select("s", F.col("p").alias("path"), "o", "o_kind", F.when(F.col("o_kind") == "literal", F.coalesce("o_datatype", F.lit("http://www.w3.org/2001/XMLSchema#string"))).alias("o_datatype")).distinct()
    counted = wanted.join(values.hint("merge"), ["s", "path"], "left")  # files say little of the size of the quads that they become, and a broadcast isn't taken back
    bad = lambda c: F.count_if(F.col("o").isNotNull() & F.coalesce(c, F.lit(False)))
    of = ["s", "target", "path", "least", "most"]
    sums = counted.groupBy(*of).agg(F.count("o").alias("n"), bad(F.col("o_kind") != F.col("kind")).alias("k"), bad(~F.col("o_datatype").eqNullSafe(F.col("datatype")) & F.col("datatype").isNotNull()).alias("t"), bad(~F.expr("o rlike pattern")).alias("f"))
    reasons = F.array(F.when(F.col("n") < F.col("least"), "too_few"), F.when(F.col("n") > F.col("most"), "too_many"), F.when(F.col("k") > 0, "node_kind"), F.when(F.col("t") > 0, "datatype"), F.when(F.col("f") > 0, "pattern"))
    return sums.select("s", "path", F.explode(F.array_compact(reasons)).alias("reason"))


def label_violations(labels: DataFrame, plans: DataFrame, with_probability: list[str], fixed: list[str]) -> DataFrame:
    """(label, reason): labels that break the rules of their source.

    ``labels``: label, source, probability, calibration, status, page, start, stop. Sources that read a text need a probability within bounds, a calibration that is among
    ``plans`` (plan), a status, a page from 1 and a span; fixed ones have none of the first three.
    """
    known = labels.join(plans.select(F.col("plan").alias("calibration"), F.lit(True).alias("_plan")).distinct(), "calibration", "left")
    reads, is_fixed = F.col("source").isin(*with_probability), F.col("source").isin(*fixed)
    p = F.col("probability")
    checks = [
        ("no_source", F.col("source").isNull()), ("unknown_source", F.col("source").isNotNull() & ~reads & ~is_fixed), ("probability", reads & (p.isNull() | (p < P_MIN) | (p > P_MAX))), ("calibration", reads & F.col("_plan").isNull()),
        ("status", reads & F.col("status").isNull()), ("page", reads & (F.col("page").isNull() | (F.col("page") < 1))), ("span", reads & (F.col("start").isNull() | F.col("stop").isNull() | (F.col("start") < 0) | (F.col("start") > F.col("stop")))),
        ("fixed_with_probability", is_fixed & (p.isNotNull() | F.col("calibration").isNotNull() | F.col("status").isNotNull())),
    ]
    return known.select("label", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))).alias("reason"))


def block_label_violations(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """(block, reason): blocks without exactly one label, labels whose page or span differs from their block's, and labels of no known block."""
    counted = labels.groupBy("block").agg(F.count("*").alias("_n"), F.min(F.struct("page", "start", "stop")).alias("_at"))
    both = blocks.select("block", F.struct("page", "start", "stop").alias("_want")).join(counted, "block", "full_outer")
    reason = F.when(F.col("_want").isNull(), "unknown_block").when(F.coalesce("_n", F.lit(0)) != 1, "not_one_label").when(F.col("_at") != F.col("_want"), "other_place")
    return both.select("block", reason.alias("reason")).where("reason is not null")


def relaxed_schema(schema: DataFrame, gaps: DataFrame, of_class: str) -> DataFrame:
    """The schema (class, slot, required, nullable) in which the recorded gaps (slot) of a class are no longer required and may be null."""
    open_slots = gaps.select("slot").distinct().withColumn("_gap", F.lit(True))
    hit = (F.col("class") == of_class) & F.col("_gap") & F.col("required")
    return schema.join(open_slots, "slot", "left").select("class", "slot", F.when(F.coalesce(hit, F.lit(False)), False).otherwise(F.col("required")).alias("required"), F.when(F.coalesce(hit, F.lit(False)), True).otherwise(F.col("nullable")).alias("nullable"))


def relaxation_problems(strict: DataFrame, relaxed: DataFrame, gaps: DataFrame, of_class: str) -> DataFrame:
    """(class, slot, reason): any difference of two schemas that isn't the relaxation of a recorded gap, and gaps that relax nothing."""
    a, b = strict.withColumnsRenamed({"required": "r1", "nullable": "n1"}), relaxed.withColumnsRenamed({"required": "r2", "nullable": "n2"})
    open_slots = gaps.select("slot").distinct().withColumn("_gap", F.lit(True))
    both = a.join(b, ["class", "slot"], "full_outer").join(open_slots, "slot", "left")
    allowed = F.coalesce(F.col("_gap") & (F.col("class") == of_class), F.lit(False))
    same = F.col("r1").eqNullSafe(F.col("r2")) & F.col("n1").eqNullSafe(F.col("n2"))
    eased = F.col("r1") & ~F.col("r2") & F.col("n2")
    reason = F.when(F.col("r1").isNull(), "added").when(F.col("r2").isNull(), "removed").when(allowed & ~F.coalesce(eased, F.lit(False)), "not_relaxed").when(~allowed & ~same, "changed")
    found = both.select("class", "slot", reason.alias("reason")).where("reason is not null")
    unknown = gaps.select("slot").distinct().join(strict.where(F.col("class") == of_class).select("slot"), "slot", "left_anti").select(F.lit(of_class).alias("class"), "slot", F.lit("no_such_slot").alias("reason"))
    return found.unionByName(unknown)


def vector_violations(vectors: DataFrame, ids: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(key, reason): stored vectors that are missing, unknown, repeated, of another width, or hold what is no finite number."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    one = vectors.groupBy(key).agg(F.count("*").alias("_n"), F.bool_and(F.col(vector).isNotNull() & (F.size(vector) == width)).alias("_wide"), F.bool_and(F.coalesce(finite, F.lit(False))).alias("_finite"))
    both = ids.select(key).distinct().withColumn("_known", F.lit(True)).join(one, key, "full_outer")
    reason = F.when(F.col("_n").isNull(), "missing").when(F.col("_known").isNull(), "unknown").when(F.col("_n") > 1, "repeated").when(~F.col("_wide"), "shape").when(~F.col("_finite"), "not_finite")
    return both.select(key, reason.alias("reason")).where("reason is not null")


def equal_over_all(features: list[DataFrame], one: Column, other: Column) -> DataFrame:
    """(combinations, differences) of two rules over all combinations of feature values; each feature is a table of its few values."""
    grid = features[0]
    for f in features[1:]:
        grid = grid.crossJoin(F.broadcast(f))  # values of one feature
    return grid.agg(F.count("*").alias("combinations"), F.count_if(~one.eqNullSafe(other)).alias("differences"))


def pinned(files: DataFrame, pins: DataFrame, name: str, content: str) -> DataFrame:
    """(name, state): ok, changed, not_pinned or missing, by the SHA-256 of a file's content."""
    found = files.select(name, F.sha2(F.col(content).cast("binary"), 256).alias("_now"))
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("sha256").isNull(), "not_pinned").when(F.col("_now") == F.col("sha256"), "ok").otherwise("changed")
    return found.join(pins.select(name, "sha256"), name, "full_outer").select(name, state.alias("state"))
