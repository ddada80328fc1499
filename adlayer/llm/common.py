"""What several operators share: staging in the shared folder, bounded sampling, row keys, joins with hot keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import scratch, stage

__all__ = ["arrow_rows", "bounded_sample", "fold_of", "node_of", "scratch", "split_join", "stage", "text_key"]


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside gets rows of many bytes each in Arrow batches of so many at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def bounded_sample(df: DataFrame, key: Column, max_rows: int, seed: int = 7) -> DataFrame:
    """About max_rows rows of df at most, chosen by a hash; all rows of a df that is no larger.

    A row is chosen by a hash of key and its other plain columns, and equal rows
    count once, so that what repeats doesn't carry the sample over its bound.
    """
    total = df.count()
    if total <= max_rows:
        return df
    whole = F.struct(*(F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind in ("string", "boolean", "float", "double") or "int" in kind or kind.startswith("decimal")))
    place = F.pmod(F.xxhash64(key, whole, F.lit(seed)), F.lit(1 << 31))
    cut = int(max_rows / total * (1 << 31))
    return df.where(place < cut).dropDuplicates()


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, mod folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def text_key(text: Column) -> Column:
    """A hash of 128 bits of a text; of its own for null."""
    return F.coalesce(F.md5(text), F.lit("null"))


def node_of(doc_id: Column, key: Column) -> Column:
    """What orders rows by id, null ids last, then by key."""
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), key.alias("key"))


def split_join(rows: DataFrame, labels: DataFrame, keys: list[str], total: int, most: int = 10_000, few: int = 512, largest: int | None = None) -> DataFrame:
    """rows joined to labels (keys, n, ...), which has each key once, with the n rows that have it of `total`.

    Keys of more than total / most rows, which are `most` at most, and of more
    than `few` are broadcast; so no task gets all rows of a hot key. Without
    any it is one plain join. keys may not be null; labels are read several times.
    largest: the greatest n, if it is known.
    """
    bound = max(total // most, few)
    if labels.where(F.col("n") > bound).isEmpty() if largest is None else largest <= bound:
        return rows.join(labels, keys)
    hot = stage(labels.where(F.col("n") > bound), "hot")
    names = F.broadcast(hot.select(keys))
    near = rows.join(F.broadcast(hot), keys)
    return near.unionByName(rows.join(names, keys, "left_anti").join(labels.where(F.col("n") <= bound), keys))
