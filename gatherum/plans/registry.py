"""The registry of queries: a function of (spark, folder of tables) and, where SQL can express it, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tasks_of(df: DataFrame, rows: int = 100_000) -> int:
    """How many tasks of about so many rows a table makes."""
    return max(1, -(-df.count() // rows))


def dealt(df: DataFrame, key: str, rows: int = 100_000) -> DataFrame:
    """The rows of a table, dealt by a key without many repeats to tasks of about so many rows.

    A file with few and narrow columns is small, so one task reads very many rows of it; what a row is made into has to be spread first.
    """
    tasks = tasks_of(df, rows)
    return df if tasks < 2 else df.repartition(tasks, key)


#: SQL of lines of documents with their places.
LINES_SQL = "(SELECT doc_id, line, text, start, start + length(text) AS stop FROM (SELECT doc_id, line, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS text FROM documents)))"
