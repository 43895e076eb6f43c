"""A folder that driver and executors share, for tables and files that a query writes and reads back."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``. Where that is unset a local master gets a folder of its own; a cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="gatherum-")) if app not in _own else _own[app]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go once its table is there, not whenever the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
