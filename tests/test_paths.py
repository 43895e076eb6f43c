import itertools

import pytest
from pyspark.sql import functions as F

from gatherum.functions import paths as P

KIND = "struct<a: struct<b: int, c: array<struct<d: string, e: array<int>>>>, m: map<string, array<int>>>"
ROWS = [
    ({"a": {"b": 1, "c": [{"d": "x", "e": [1, 2]}, {"d": None, "e": None}]}, "m": {"k": [5]}},),
    ({"a": None, "m": None},), (None,), ({"a": {"b": None, "c": []}, "m": {}},),
]


def put(value, way, new, kinds):
    """The same in plain Python."""
    if not way:
        return new
    step = way[0]
    if isinstance(step, int):
        value = list(value or [])
        value += [None] * (step + 1 - len(value))
        value[step] = put(value[step], way[1:], new, kinds)
        return value
    value = dict(value) if value else dict.fromkeys(kinds.get(step, ()))
    value[step] = put(value.get(step), way[1:], new, kinds)
    return value


@pytest.mark.parametrize("path", ["a.b", "a.c[0].d", "a.c[1].e[2]", "a.c[3].d", "m.k[0]", "m.new[1]"])
def test_set_then_get(spark, path):
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(ROWS)], f"k int, v {KIND}")
    kind = df.schema["v"].dataType
    new = F.lit("7")
    out = df.select("k", P.set_path(F.col("v"), kind, path, new).alias("v"))
    assert out.schema["v"].dataType.simpleString() == kind.simpleString()
    got = {r["k"]: r["v"].asDict(True) for r in out.collect()}
    fields = {"a": ("a", "m"), "m": ("a", "m"), "b": ("b", "c"), "c": ("b", "c"), "d": ("d", "e"), "e": ("d", "e")}
    for k, (value,) in enumerate(ROWS):
        assert got[k] == put(value, P.steps(path), "7" if path.endswith("d") else 7, fields), (path, k)
    assert {r[0] for r in out.select(P.get_path(F.col("v"), kind, path).cast("string")).collect()} == {"7"}


def test_paths_that_are_none(spark):
    kind = spark.createDataFrame([], f"v {KIND}").schema["v"].dataType
    for path in ("a.x", "a[0]", "m.k.b", "a.c.d"):
        with pytest.raises(ValueError):
            P.get_path(F.col("v"), kind, path)
    for path in ("a..b", "a[x]", "[0", "a[0]b"):
        with pytest.raises(ValueError):
            P.steps(path)
    assert P.steps("a.c[10][2].d e") == ["a", "c", 10, 2, "d e"] and list(itertools.chain(P.steps(""))) == []
