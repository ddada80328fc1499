"""Numbers, running sums and carried values over all rows in order, without a window that takes them all.

Rows are dealt by ranges of the order and written to the shared folder; what
the ranges before hold is added to what stands before a row within its range.
A range is about as large as any other, whatever the values, if the order
tells most rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

_LOW = (1 << 33) - 1


def ranged(df: DataFrame, order: list[str | Column], ranges: int | None = None) -> DataFrame:
    """df with `_range`, the number of the row's range, and `_in`, its place in it from 0; ranges follow each other in the order.

    ranges: how many there are at most; by default as many as a shuffle has partitions.
    """
    dealt = (df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return stage(dealt.withColumn("_range", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND(F.lit(_LOW))).drop("_id"), "ordered")


def _earlier(by: list[str]) -> Window:
    """The ranges before, for each value of by; one row for a range and value."""
    return Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, order: list[str | Column], name: str = "n") -> DataFrame:
    """df with its place in the order, from 1."""
    dealt = ranged(df, order)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    starts = counts.select("_range", F.coalesce(F.sum("_size").over(_earlier([])), F.lit(0)).alias("_before"))  # a row for each range
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_range", "_in", "_before")


def running_sums(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """df with, for each name in sums, the sum of that column over the row and those before it with the same values of by (null-free)."""
    dealt = ranged(df, [*by, *order])
    each = dealt.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_of_{n}") for n, c in sums.items()))
    starts = each.select(*by, "_range", *(F.coalesce(F.sum(f"_of_{n}").over(_earlier(by)), F.lit(0)).alias(f"_of_{n}") for n in sums))
    within = Window.partitionBy(*by, "_range").orderBy("_in").rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"_in_{n}": F.sum(c).over(within) for n, c in sums.items()})
    return summed.join(starts, [*by, "_range"]).withColumns({n: F.col(f"_in_{n}") + F.col(f"_of_{n}") for n in sums}).select(*df.columns, *sums)


def last_known(df: DataFrame, by: list[str], order: list[str | Column], values: dict[str, str], ranges: int | None = None) -> DataFrame:
    """df with, for each name in values, that column's last value other than null in the row or those before it with the same values of by."""
    dealt = ranged(df, [*by, *order], ranges)
    held = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_in"))).alias(f"_of_{n}") for n, c in values.items()]
    each = dealt.groupBy(*by, "_range").agg(*held)
    starts = each.select(*by, "_range", *(F.last(f"_of_{n}", ignorenulls=True).over(_earlier(by)).alias(f"_of_{n}") for n in values))
    within = Window.partitionBy(*by, "_range").orderBy("_in").rowsBetween(Window.unboundedPreceding, 0)
    known = dealt.withColumns({f"_in_{n}": F.last(c, ignorenulls=True).over(within) for n, c in values.items()})
    return known.join(starts, [*by, "_range"]).withColumns({n: F.coalesce(f"_in_{n}", f"_of_{n}") for n in values}).select(*df.columns, *values)
