"""Places in nested values: "items[2].name", with struct fields, map keys and indices of arrays, read and set by column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

_STEP = re.compile(r"\.?(?:(?P<name>[^.\[\]]+)|\[(?P<index>\d+)\])")


def steps(path: str) -> list[str | int]:
    """The steps of a path; an index is a number."""
    out: list[str | int] = []
    at = 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or (m["name"] and at and path[at] != "."):
            raise ValueError(f"{path!r}: no step at {at}")
        out.append(m["name"] if m["index"] is None else int(m["index"]))
        at = m.end()
    return out


def _inner(kind: DataType, step: str | int) -> DataType:
    if isinstance(kind, StructType) and isinstance(step, str) and step in kind.names:
        return kind[step].dataType
    if isinstance(kind, ArrayType) and isinstance(step, int):
        return kind.elementType
    if isinstance(kind, MapType) and isinstance(step, str):
        return kind.valueType
    raise ValueError(f"{kind.simpleString()} has no {step!r}")


def get_path(value: Column, kind: DataType, path: str | list[str | int]) -> Column:
    """What stands at a path of a value of type ``kind``; null where the way there is missing."""
    for step in steps(path) if isinstance(path, str) else path:
        inner = _inner(kind, step)
        value = F.get(value, F.lit(step)) if isinstance(step, int) else F.try_element_at(value, F.lit(step)) if isinstance(kind, MapType) else value[step]
        kind = inner
    return value


def set_path(value: Column, kind: DataType, path: str | list[str | int], new: Column) -> Column:
    """The value with ``new`` at a path; all else stays.

    What is missing on the way is made: a null struct gets null fields, a null map or array is an empty one, an array is filled up with
    nulls to the index, and a map takes a new key. Nothing is exploded, so order and rows stay.
    """
    way = steps(path) if isinstance(path, str) else path
    if not way:
        return new.cast(kind)
    step, rest = way[0], way[1:]
    inner = _inner(kind, step)
    if isinstance(kind, StructType):
        whole = F.coalesce(value, F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind]))
        return whole.withField(f"`{step}`", set_path(whole[step], inner, rest, new))
    if isinstance(kind, MapType):
        whole = F.coalesce(value, F.create_map().cast(kind))
        fresh = F.create_map(F.lit(step).cast(kind.keyType), set_path(F.try_element_at(whole, F.lit(step)), inner, rest, new))
        return F.map_concat(F.map_filter(whole, lambda k, _: k != step), fresh)
    whole = F.coalesce(value, F.array().cast(kind))
    places = F.sequence(F.lit(0), F.greatest(F.size(whole) - 1, F.lit(step)))
    return F.transform(places, lambda i: F.when(i == step, set_path(F.get(whole, F.lit(step)), inner, rest, new)).otherwise(F.get(whole, i)))
