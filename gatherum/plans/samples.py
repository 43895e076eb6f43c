"""Rows that hit every rule of a table, dealt over the rows of a driver table, with the results that they must give written out by hand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(value: object) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def values_sql(name: str, columns: list[str], rows: list[tuple]) -> str:
    """A table of literals for a FROM clause."""
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) {name}({', '.join(columns)})"


@dataclass(frozen=True)
class Samples:
    """``inputs``: a schema and, first in each row, what the operator is given; ``results``: names and, behind, what must come out."""

    inputs: str
    results: tuple[str, ...]
    rows: list[tuple]

    @property
    def width(self) -> int:
        return len(self.inputs.split(","))

    def table(self, spark) -> DataFrame:
        """(k, inputs): the inputs with their number."""
        return spark.createDataFrame([(k, *r[: self.width]) for k, r in enumerate(self.rows)], f"k int, {self.inputs}")

    def over(self, df: DataFrame, key: str) -> DataFrame:
        """Each row of ``df`` gets one sample, by its key: (key, inputs). The samples are a fixed number of rows."""
        picked = df.select(key, F.pmod(F.col(key), F.lit(len(self.rows))).cast("int").alias("k"))
        return picked.join(F.broadcast(self.table(df.sparkSession)), "k").drop("k")

    def sql(self, table: str, key: str) -> str:
        """The expected results: (key, results)."""
        rows = [(k, *r[self.width :]) for k, r in enumerate(self.rows)]
        return f"SELECT {key}, {', '.join(self.results)} FROM {table} JOIN {values_sql('s', ['k', *self.results], rows)} ON {key} % {len(self.rows)} = s.k"

    def of_each(self, df: DataFrame, key: str) -> DataFrame:
        """Each row of ``df`` gets all samples: a document made of them. (key, k, inputs)"""
        return df.select(key).crossJoin(F.broadcast(self.table(df.sparkSession)))  # a fixed number of rows

    def of_each_sql(self, table: str, key: str) -> str:
        rows = [(k, *r[self.width :]) for k, r in enumerate(self.rows)]
        return f"SELECT {key}, k, {', '.join(self.results)} FROM {table}, {values_sql('s', ['k', *self.results], rows)}"
