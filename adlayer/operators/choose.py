"""Weighted choice: which of a table's rows does a uniform number fall on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import last_known, running_sums


def cumulative(choices: DataFrame, by: list[str], order: str, weight: str) -> DataFrame:
    """choices with lo and hi, the span of each in the running sum of weights, and total, its end; by values may not be null."""
    summed = running_sums(choices, by, [order], {"hi": weight}).withColumn("lo", F.col("hi") - F.col(weight))
    ends = choices.groupBy(*by).agg(F.sum(weight).alias("total"))
    return summed.join(ends, by) if by else summed.crossJoin(F.broadcast(ends))  # without by, one row


def by_range(draws: DataFrame, spans: DataFrame, u: str = "u") -> DataFrame:
    """draws joined to the span of cumulative() that u x total falls in; spans: a small table, such as a catalogue."""
    at = F.col(u) * F.col("total")
    return draws.join(spans, (F.col("lo") <= at) & (at < F.col("hi")))


def by_search(draws: DataFrame, spans: DataFrame, u: str = "u", slices: int | None = None) -> DataFrame:
    """by_range for many choices: spans of one table and draws stand in one order, and each draw takes the last span before it.

    The order is dealt by ranges, so neither many draws on one choice nor many
    choices within a small part of the total are one task, and no draw meets
    more than its span. slices: how many ranges, at most.
    """
    total = F.broadcast(spans.agg(F.max("total").alias("_total")))  # one row
    own = spans.where(F.col("hi") > F.col("lo")).select(F.col("lo").cast("double").alias("_at"), F.lit(0).alias("_side"), F.struct(*spans.columns).alias("_span"))
    asked = draws.crossJoin(total).select((F.col(u) * F.col("_total")).alias("_at"), F.lit(1).alias("_side"), F.struct(*draws.columns).alias("_draw"))
    found = last_known(own.unionByName(asked, allowMissingColumns=True), [], ["_at", "_side"], {"_found": "_span"}, slices)
    return found.where((F.col("_side") == 1) & (F.col("_at") < F.col("_found.hi"))).select("_draw.*", "_found.*")
