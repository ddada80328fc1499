"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset: a temporary folder if all runs on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
    name = spark.sparkContext.applicationId
    if name not in _local:
        _local[name] = tempfile.mkdtemp(prefix="adlayer-")
    return _local[name]


class _Open(threading.local):
    """What is open in a thread: each has its own tables."""

    def __init__(self) -> None:
        self.tables: list[list[str]] = []


_open = _Open()


def stage(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again; outer: the table outlives the innermost scratch()."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if at := _open.tables[: len(_open.tables) - outer]:
        at[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, but for outer ones; nothing that reads them may be left to run."""
    _open.tables.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _open.tables.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
