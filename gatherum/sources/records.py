"""Sources and sinks: line-delimited JSON with early filters, CSV, binary files, N-Quads, records with hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType


def read_ndjson(spark: SparkSession, path: str, schema: StructType, contains: str | None = None) -> DataFrame:
    """Objects of line-delimited JSON (gzip too). ``contains``: lines without this text are dropped before they are parsed.

    Lines that are no object have nulls and the line itself in ``_corrupt``.
    """
    return parse_lines(spark.read.text(path), schema, contains)


def parse_lines(lines: DataFrame, schema: StructType, contains: str | None = None) -> DataFrame:
    """``read_ndjson`` on lines that are there (column ``value``)."""
    if contains is not None:
        lines = lines.where(F.col("value").contains(contains))
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.where(F.trim("value") != "").select(parsed.alias("x")).select("x.*")


def parse_errors(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, lines, errors) of each file."""
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    rows = spark.read.text(path).withColumn("file", F.input_file_name()).where(F.trim("value") != "")
    parsed = rows.withColumn("x", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.col("x._corrupt").isNotNull()).alias("errors"))


def read_wanted(spark: SparkSession, path: str, schema: StructType, key: str, wanted: DataFrame) -> DataFrame:
    """Objects whose ``key`` is in ``wanted`` (one column of that name): the key is read from the raw line, and only lines that
    survive the semi-join are parsed, with the fields of ``schema`` only."""
    return parse_wanted(spark.read.text(path), schema, key, wanted)


def parse_wanted(lines: DataFrame, schema: StructType, key: str, wanted: DataFrame) -> DataFrame:
    """``read_wanted`` on lines that are there (column ``value``)."""
    found = F.coalesce(F.regexp_extract("value", rf'"{key}"\s*:\s*"?([^",}}\s]+)"?', 1), F.lit(""))
    keys = wanted.select(F.col(key).cast("string").alias("_key")).distinct()
    return lines.withColumn("_key", found).join(keys, "_key", "left_semi").select(F.from_json("value", schema).alias("x")).select("x.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all strings; of columns with the same name the last stays."""
    df = spark.read.option("header", False).csv(path)
    head = spark.read.option("header", False).csv(path).limit(1).first()
    if head is None:
        return df
    last = {name: c for c, name in zip(df.columns, head) if name is not None}
    order = [n for n in dict.fromkeys(head) if n is not None]
    first = F.concat_ws("\u0001", *df.columns) == "\u0001".join(x or "" for x in head)
    return df.where(~first).select(*[F.col(last[n]).alias(n) for n in order])


def first_of_json(column: str, keys: list[str]) -> Column:
    """The first whole number among keys of a JSON object."""
    return F.coalesce(*[F.get_json_object(column, f"$.{k}").try_cast("int") for k in keys])


def key_frequencies(df: DataFrame, column: str) -> DataFrame:
    """(key, n): how often each key occurs in a JSON object column."""
    return df.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def sound_files(files: DataFrame, mark: str = "%PDF-", head: int = 1024, least: int = 5, most: int = 20_000_000) -> DataFrame:
    """Adds ``refused`` to binary files: too_small, too_large, no_mark; null if sound."""
    head_text = F.decode(F.substring("content", 1, head), "ISO-8859-1")
    return files.withColumn("refused", F.when(F.length("content") < least, "too_small").when(F.length("content") > most, "too_large").when(~head_text.contains(mark), "no_mark"))


def not_stored(inputs: DataFrame, stored: DataFrame, content: str, key: str = "sha256") -> DataFrame:
    """Inputs without a stored result, by the SHA-256 of their content."""
    return inputs.withColumn(key, F.sha2(F.col(content).cast("binary"), 256)).join(stored.select(key).distinct(), key, "left_anti")


def canonical_json_hash(record: Column) -> Column:
    """SHA-256 of a map as JSON with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(record)))).cast("binary"), 256)


def checksums(files: DataFrame, name: str, content: str) -> DataFrame:
    """Lines of a checksum list, by name."""
    return files.select(F.concat(F.sha2(F.col(content).cast("binary"), 256), F.lit("  "), F.col(name)).alias("line"), F.col(name)).orderBy(name).select("line")


def write_lines(df: DataFrame, path: str) -> None:
    """Rows of one text column as lines (N-Quads, JSON)."""
    df.write.text(path)


def write_csv(df: DataFrame, path: str, names: list[str]) -> None:
    """Gzipped CSV files whose header has the given names, which may repeat; all cells as text. Each file has the header as its first line."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", *[quoted(F.col(f"`{c}`")) for c in df.columns])
    head = ",".join('"' + n.replace('"', '""') + '"' for n in names)
    _with_head(df.select(line.alias("value")), head, path)


def _with_head(lines: DataFrame, head: str, path: str) -> None:
    """Lines in files that each begin with a head line: the head is a row of every partition, written first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    lines.mapInArrow(run, "value string").write.option("compression", "gzip").text(path)


def write_sorted(df: DataFrame, path: str, keys: list[str]) -> None:
    """Gzipped tab-separated lines, sorted over all files: ranges of keys are parts, and each part is sorted. Read in the order of their names the files are one sorted file."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(line.alias("value")).write.option("compression", "gzip").text(path)
