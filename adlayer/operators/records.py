"""Energy records: metal and facet filters with fallback, quantile buckets, counts by species."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BUCKETS
from ..staging import stage
from .ordered import numbered


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """df, or an error if it is empty."""
    if df.isEmpty():
        raise ValueError(f"{what} has no records")
    return df


def with_fallback(records: DataFrame, metal: int | str | None, facet: int | str | None, least: int = BUCKETS) -> DataFrame:
    """Records of a metal and facet; a species with fewer than `least` of the facet, and more of the metal, keeps all of the metal.

    Without a metal nothing is filtered, whatever the facet. The counts are two
    numbers a species, made before any shuffle of rows.
    """
    if metal is None:
        return records
    own = records.where(F.col("metal") == metal)
    if facet is None:
        return own
    counts = own.groupBy("species").agg(F.count("*").alias("_all"), F.count_if(F.col("facet") == facet).alias("_facet"))
    wide = counts.where((F.col("_facet") < least) & (F.col("_all") > F.col("_facet"))).select("species", F.lit(True).alias("_wide"))
    return own.join(wide, "species", "left").where((F.col("facet") == facet) | F.coalesce("_wide", F.lit(False))).drop("_wide").select(records.columns)


def pairs_with_fallback(records: DataFrame, metal: int | str | None, facet: int | str | None) -> DataFrame:
    """Two-site records of a metal and facet; all of the metal if the facet has none."""
    if metal is None:
        return records
    own = records.where(F.col("metal") == metal)
    if facet is None:
        return own
    some = own.agg(F.coalesce(F.bool_or(F.col("facet") == facet), F.lit(False)).alias("_some"))
    return own.crossJoin(F.broadcast(some)).where((F.col("facet") == facet) | ~F.col("_some")).drop("_some")  # one row


def species_counts(records: DataFrame, species: DataFrame) -> DataFrame:
    """(species, n, with_barrier) for every row of species (species), those without records too."""
    counts = records.groupBy("species").agg(F.count("*").alias("n"), F.count("real_ea_mev").alias("with_barrier"))
    return species.select("species").join(counts, "species", "left").fillna(0, ["n", "with_barrier"])


#: Accuracy of the sketches, and the share of ranks around a cut that they leave open.
SKETCH, OPEN = 4000, 0.002
#: Species up to which what is known of each is sent to all tasks.
FEW = 10_000


def _brackets(rows: DataFrame, buckets: int) -> DataFrame:
    """A row for each species: n, and for each cut between buckets its rank from 0 and the energies lo and hi that the row of that rank should lie between.

    A mergeable sketch of the species' energies tells these.
    """
    shares = [b / buckets for b in range(1, buckets)]
    at = lambda by: F.kll_sketch_get_quantile_bigint("sketch", F.array(*(F.lit(min(1.0, max(0.0, x + by))) for x in shares)))
    known = rows.groupBy("species").agg(F.count("*").alias("n"), F.min("e").alias("low"), F.max("e").alias("high"), F.kll_sketch_agg_bigint("e", F.lit(SKETCH)).alias("sketch"))
    if shares:
        known = known.withColumn("los", at(-OPEN)).withColumn("his", at(OPEN))
    few = F.col("n") < buckets  # then a cut isn't at a share of the ranks
    cuts = {}
    for i in range(1, buckets):
        cuts |= {f"rank{i}": F.floor(F.lit(i) * F.col("n") / buckets), f"lo{i}": F.when(few, F.col("low")).otherwise(F.col("los")[i - 1]), f"hi{i}": F.when(few, F.col("high")).otherwise(F.col("his")[i - 1])}
    return known.select("species", "n", "low", "high", *(c.alias(x) for x, c in cuts.items()))


def _known(rows: DataFrame, each: DataFrame) -> DataFrame:
    """rows joined to a row of each species; it is broadcast if there are few, so that a large species isn't one task."""
    return rows.join(F.broadcast(each) if each.limit(FEW + 1).count() <= FEW else each, "species")


def quantile_buckets(records: DataFrame, order: list[Column], buckets: int = BUCKETS) -> DataFrame:
    """(species, bucket, n, mean_energy_mev, mean_ea_mev) of equal-count energy buckets of each species.

    With n records there are B = min(buckets, n) buckets, and bucket b takes
    the ranks from floor(b n / B) on, by energy (null first), then order, which
    should tell rows apart. mean_ea_mev is over measured barriers only, null
    without any. Sums are of integers, so no order changes them. Records
    without a species are left out.

    No table is sorted: an energy beyond all brackets of the cuts tells its
    bucket by itself, and such rows are summed where they are. Only rows within
    a bracket, a few thousandths or those of one frequent energy, get exact
    ranks, in the order of ranges.
    """
    names = [f"_o{i}" for i in range(len(order))]
    rows = records.where("species is not null").select("species", "energy_mev", "real_ea_mev", F.coalesce(F.col("energy_mev").cast("long"), F.lit(-(1 << 62))).alias("e"), *(c.alias(n) for c, n in zip(order, names)))
    sums = [F.count("*").alias("_n"), F.sum(F.col("energy_mev").cast("long")).alias("_e"), F.sum(F.col("real_ea_mev").cast("long")).alias("_ea"), F.count("real_ea_mev").alias("_barriers")]
    cuts, e = range(1, buckets), F.col("e")
    total = lambda of: sum((c.cast("int") for c in of), F.lit(0))
    below = total([F.col(f"hi{i}") < e for i in cuts])
    near = total([e.between(F.col(f"lo{i}"), F.col(f"hi{i}")) for i in cuts]) > 0
    known = stage(_brackets(rows, buckets), "brackets")
    while True:
        placed = _known(rows, known).withColumn("_below", below).withColumn("_near", near)
        counts = [F.count_if(e < F.col(f"lo{i}")).alias(f"under{i}") for i in cuts] + [F.count_if(e <= F.col(f"hi{i}")).alias(f"upto{i}") for i in cuts]
        parts = stage(placed.groupBy("species", "_below", "_near").agg(*sums, *counts), "parts")
        counted = known.join(parts.groupBy("species").agg(*(F.sum(f"{c}{i}").alias(f"{c}{i}") for i in cuts for c in ("under", "upto")), F.count("*").alias("_parts")), "species")
        missed = {i: (F.col("n") >= buckets) & ((F.col(f"under{i}") > F.col(f"rank{i}")) | (F.col(f"upto{i}") <= F.col(f"rank{i}"))) for i in cuts}
        if not cuts or counted.where(total(missed.values()) > 0).isEmpty():
            break
        wide = {f"{x}{i}": F.when(m, F.col(end)).otherwise(F.col(f"{x}{i}")) for i, m in missed.items() for x, end in (("lo", "low"), ("hi", "high"))}
        known = stage(counted.withColumns(wide).select(known.columns), "brackets")
    far = parts.where("not _near").groupBy("species", F.col("_below").alias("bucket")).agg(*(F.sum(c).alias(c) for c in ("_n", "_e", "_ea", "_barriers")))
    ranked = numbered(placed.where("_near").select("species", "energy_mev", "real_ea_mev", "e", "_below", *names, "n"), ["species", "e", *names], "_place")
    starts = ranked.groupBy("species").agg(F.min("_place").alias("_first"))
    outside = far.groupBy("species").agg(*(F.sum(F.when(F.col("bucket") <= j, F.col("_n"))).alias(f"_upto{j}") for j in range(buckets)))
    passed = F.coalesce(F.get(F.array(*(f"_upto{j}" for j in range(buckets))), F.col("_below")), F.lit(0))
    rank, of = F.col("_place") - F.col("_first") + passed, F.least(F.lit(buckets), F.col("n"))
    bucket = F.floor(((rank + 1) * of - 1) / F.col("n")).cast("int")
    both = _known(ranked, starts.join(outside, "species", "left")).withColumn("bucket", bucket).groupBy("species", "bucket").agg(*sums).unionByName(far)
    whole = both.groupBy("species", "bucket").agg(*(F.sum(c).alias(c) for c in ("_n", "_e", "_ea", "_barriers")))
    return whole.select("species", "bucket", F.col("_n").alias("n"), (F.col("_e") / F.col("_n")).alias("mean_energy_mev"), (F.col("_ea") / F.nullif(F.col("_barriers"), F.lit(0))).alias("mean_ea_mev"))
