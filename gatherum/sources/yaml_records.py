"""Nested records as YAML text, and back, for the block form that is written here: mappings, lists and scalars in JSON's quoting."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType


def _scalar(c: Column, kind: DataType) -> Column:
    if isinstance(kind, StringType):
        form = c
        for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            form = F.replace(form, F.lit(raw), F.lit(safe))
        form = F.concat(F.lit('"'), form, F.lit('"'))
    else:
        form = c.cast("string")
    return F.coalesce(form, F.lit("null"))


def _item(pad: str, kind: DataType) -> Callable[[Column], Column]:
    return lambda x: F.concat(F.lit(f"\n{pad}- "), _scalar(x, kind))


def to_yaml(c: Column, kind: DataType, depth: int = 0) -> Column:
    """A struct as YAML lines; lists of scalars as items, empty lists as []. JVM only."""
    pad, lines = "  " * depth, []
    for field in kind.fields:  # type: ignore[attr-defined]
        value, name = c[field.name], F.lit(f"{pad}{field.name}:")
        if isinstance(field.dataType, StructType):
            lines.append(F.when(value.isNull(), F.concat(name, F.lit(" null"))).otherwise(F.concat(name, F.lit("\n"), to_yaml(value, field.dataType, depth + 1))))
        elif isinstance(field.dataType, ArrayType):
            items = F.array_join(F.transform(value, _item(pad, field.dataType.elementType)), "")
            lines.append(F.when(value.isNull(), F.concat(name, F.lit(" null"))).when(F.size(value) == 0, F.concat(name, F.lit(" []"))).otherwise(F.concat(name, items)))
        else:
            lines.append(F.concat(name, F.lit(" "), _scalar(value, field.dataType)))
    return F.concat_ws("\n", *lines)


_LINE = re.compile(r"( *)(?:- (.*)|([^:\s][^:]*):(?: (.*))?)$")


def parse_yaml(text: str) -> dict:
    """The record of a text in the written form; ValueError names the line that isn't."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(0, root)]
    waiting: tuple[dict, str, int] | None = None
    for number, line in enumerate(text.split("\n"), 1):
        if not line.strip():
            continue
        m = _LINE.match(line)
        if not m or len(m[1]) % 2:
            raise ValueError(f"line {number} is no entry")
        depth = len(m[1]) // 2
        if m[2] is not None:
            if waiting is None or depth != waiting[2]:
                raise ValueError(f"line {number} is an item of no list")
            owner, key, _ = waiting
            owner[key] = [*(owner[key] or []), json.loads(m[2])]
            continue
        while stack[-1][0] > depth:
            stack.pop()
        if waiting is not None and depth == waiting[2] + 1 and waiting[0][waiting[1]] is None:
            waiting[0][waiting[1]] = {}
            stack.append((depth, waiting[0][waiting[1]]))
        if stack[-1][0] != depth:
            raise ValueError(f"line {number} is indented too far")
        here = stack[-1][1]
        here[m[3]] = None if m[4] is None else json.loads(m[4])
        waiting = (here, m[3], depth) if m[4] is None else None
    return root


def from_yaml(texts: DataFrame, key: str, text: str, kind: StructType) -> DataFrame:
    """(key, record, error): records of YAML texts, of the given type; a text that isn't in the written form has its error and a null record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, value in zip(batch[key], batch[text]):
                try:
                    rows.append((k, json.dumps(parse_yaml(value or "")), None))
                except ValueError as e:
                    rows.append((k, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "json", "error"])

    parsed = texts.select(key, text).mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, json string, error string")
    return parsed.select(key, F.from_json("json", kind).alias("record"), "error")
