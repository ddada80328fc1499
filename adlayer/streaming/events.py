"""Event logs as streams: windowed counts, sessions, and coverage that grows with the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X


def read_events(spark: SparkSession, path: str, schema, files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def _watermarked(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """events that wait so long for late rows; watermarks need times with a zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """(start, key, n) of events by window of time; late: how long a stream waits for rows."""
    rows = _watermarked(events, time, late)
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(span.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, end, n) of runs of events that are less than gap apart."""
    rows = _watermarked(events, time, late)
    return rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def net_transitions(events: DataFrame, transition: Column) -> DataFrame:
    """(transition, n) running totals of what events did, whatever their order: a stream's state is a row for each transition."""
    t = events.withColumn("transition", transition)
    return t.groupBy("transition").agg(F.count("*").alias("n")).withColumn("reactant", X.reactant_of(F.col("transition"))).withColumn("product", X.product_of(F.col("transition")))
