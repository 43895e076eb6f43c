"""What the operators of this subpackage share: the scratch folder, written tables, and table reading."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space (Java and Python regex, RE2 alike).
WORD = r"[^\x20\x09-\x0D]+"

_own_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local master gets one of its own; on a cluster it must be set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = "file://" + tempfile.mkdtemp(prefix="gatherum-")
    return _own_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


#: Folders of written tables, of each scope that is open.
_scopes: list[list[str]] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with a copy that survives lost executors, gives the planner true sizes, and keeps costly
    expressions from running twice.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    keep_in_scope(path)
    return out


def keep_in_scope(path: str) -> None:
    """The folder goes at the end of the innermost open scope, if there is one."""
    for held in _scopes[-1:]:
        held.append(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` has given and that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df._scratch)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within the scope are deleted at its end: for work whose result is written elsewhere before that."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


#: A key is hot if it has more than this share of the rows; so there are fewer hot keys than its reverse, whatever the data.
HOT_SHARE = 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row per ``key`` and in ``size`` the number of rows with it; an inner join.

    Facts of hot keys are fewer than HOT_SHARE and are sent to the executors, so the rows with those keys aren't shuffled; all others
    meet in a join by key, in which no key has many rows. Both tables should be written ones, as they are read twice. Keys aren't null.
    """
    hot = F.col(size) * HOT_SHARE > total
    often = facts.where(hot)
    quick = rows.join(F.broadcast(often), key)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(facts.where(~hot), key)
    return quick.unionByName(rest)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, for work that keeps much for each text."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
