"""Mixing sources to target weights by capped water-filling.

A source's share of all words goes by its weight, but stops at `epochs` times
its own words; what a source cannot take goes to the others by weight, until
none is above its cap. With sources ordered by words per weight the capped
ones come first, so running sums find the level without a loop.

Each source then takes whole repetitions of all its documents and, for the
rest, documents in the order of a keyed hash up to the words still missing.
That order is never sorted as a whole: words are summed by hash bin, the bin
in which the quota ends is found, and only that bin's documents are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_key

BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weigh_in_turn(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, weight): the weights in turn over the distinct sources by code point, null last."""
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source").distinct().select("source", F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int")).alias("weight"))


def fill(sizes: DataFrame, weights: DataFrame, epochs: int = 3) -> DataFrame:
    """(source, source_size, target double) from one row for each source: sizes (source, source_size), weights (source, weight).

    A source without words or with no positive weight has target 0.
    """
    weights = weights.select(F.col("source").alias("of"), "weight")
    known = sizes.join(weights, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)).alias("weight"))
    cap = F.col("source_size") * epochs
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    live = known.withColumn("total", F.sum("source_size").over(everything)).withColumn("cap", cap)
    able = live.where("weight > 0 and source_size > 0")
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = able.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    water = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level")))).over(everything)["level"]
    filled = levels.withColumn("water", water).withColumn("target", F.when(F.col("water").isNull() | (F.col("water") * F.col("weight") > F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight")))
    none = live.where("not (weight > 0 and source_size > 0)").select("source", "source_size", F.lit(0.0).alias("target"))
    return filled.select("source", "source_size", "target").unionByName(none)


def key_of(doc_id: Column, seed: int) -> Column:
    """32 hex digits that order the documents."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("-"))).cast("binary"))


def mix(docs: DataFrame, weights: DataFrame | None = None, epochs: int = 3, seed: int = 11) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, repeats, text_key) for each row of docs (doc_id, text, source).

    size: words of the text, null 0. repeats: how often the mix takes the
    document; taken: repeats x size. weights: (source, weight), by default 1,
    2, 3 in turn. Null is a source like any other. Rows with one doc_id are
    ordered by size, then text_key, a hash of the text; equal ones among them
    are alike, and any may be the one that the quota ends at. Sources are taken to be few against documents: one
    task orders their sizes. Other columns of docs don't matter; an empty table
    gives an empty mix.
    """
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), seed).alias("key"), text_key(F.col("text")).alias("text_key"))
    sized = stage(sized.withColumn("bin", (F.conv(F.substring("key", 1, 3), 16, 10)).cast("int")), "sizes")  # texts are split into words once
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    weights = weigh_in_turn(sized.select("source")) if weights is None else weights
    by_source = bins.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = fill(by_source, weights, epochs)
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("int")
    targets = targets.withColumn("whole", whole).withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
    over = Window.partitionBy("source").orderBy("bin")
    cut = (
        bins.withColumnRenamed("source", "of")
        .join(targets, F.col("of").eqNullSafe(F.col("source")))
        .drop("of")
        .withColumn("upto", F.sum("words").over(over))
        .withColumn("below", F.col("upto") - F.col("words"))
        .select(F.col("source").alias("of"), F.col("bin").alias("of_bin"), "source_size", "target", "whole", "quota", "below", "upto")
    )
    placed = sized.join(cut, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("of_bin")))
    ends = (F.col("below") < F.col("quota")) & (F.col("upto") > F.col("quota"))
    names = ["doc_id", "source", "size", "source_size", "target", "whole", "text_key"]
    clear = placed.where(~ends).select(*names, ((F.col("quota") > 0) & (F.col("upto") <= F.col("quota"))).cast("int").alias("once"))
    run = F.sum("size").over(Window.partitionBy("source", "bin").orderBy("key", "size", "text_key").rowsBetween(Window.unboundedPreceding, 0))
    tight = placed.where(ends).withColumn("run", F.col("below") + run).select(*names, (F.col("run") - F.col("size") / 2 <= F.col("quota")).cast("int").alias("once"))
    repeats = F.col("whole") + F.col("once")
    return clear.unionByName(tight).select("doc_id", "source", "size", "source_size", "target", (repeats * F.col("size")).cast("long").alias("taken"), repeats.cast("int").alias("repeats"), "text_key")
