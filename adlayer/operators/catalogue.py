"""The reaction catalogue: from energy buckets and two-site records to packed, rescaled reactions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import splitmix
from ..schemas import LANES
from .ordered import last_known, numbered


# The default constants of the rate law.
@dataclass(frozen=True)
class Kinetics:
    alpha: float = 0.87
    beta: float = 0.0
    nu: float = 1e13
    temperature: float = 298.15


def replaced_desorptions(pairs: DataFrame) -> DataFrame:
    """(species) whose desorption a measured recombination with itself stands for."""
    return pairs.where(~F.col("is_dissociative") & (F.col("species_a") == F.col("species_b"))).select(F.col("species_a").alias("species")).distinct()


def _row(emit: int, k: Column, a: Column, b: Column, two: bool, bucket: Column, category: str) -> Column:
    return F.struct(F.lit(emit).alias("emit"), k.alias("k"), a.cast("int").alias("transition_a"), b.cast("int").alias("transition_b"), F.lit(two).alias("is_bimolecular"), bucket.cast("int").alias("bin_id"), F.lit(category).alias("category"))


def one_site_rates(buckets: DataFrame, species: DataFrame, pairs: DataFrame, kinetics: Kinetics) -> DataFrame:
    """Adsorption, and desorption unless it is replaced, of each bucket: one pass, each bucket exploded into its rows.

    species: (species, bit, role), eight at most. Dissociative species adsorb on
    two sites at once; those that only form on the surface give nothing.
    """
    known = species.where("role <> 'product_only'").join(replaced_desorptions(pairs).withColumn("_replaced", F.lit(True)), "species", "left")
    energy = F.col("mean_energy_mev") / 1000.0
    ea = X.activation_ev(energy, F.col("mean_ea_mev") / 1000.0, kinetics.alpha, kinetics.beta)
    k = lambda e: X.rate(e, kinetics.nu, kinetics.temperature)
    bit, none = F.col("bit"), F.lit(0)
    dissociates = F.col("role") == "dissociative"
    adsorbs = F.when(dissociates, _row(0, k(F.col("_ea")), bit, bit, True, none, "dissociative_adsorption")).otherwise(_row(0, k(F.col("_ea")), bit, none, False, F.col("bucket"), "adsorption"))
    desorbs = _row(1, k(X.reverse_ev(F.col("_ea"), energy)), F.shiftleft(bit, 8), none, False, F.col("bucket"), "desorption")
    rows = F.filter(F.array(adsorbs, F.when(F.col("_replaced").isNull(), desorbs)), lambda x: x.isNotNull())
    return buckets.join(known, "species").withColumn("_ea", ea).select(F.lit(0).alias("part"), F.col("species").cast("string").alias("of"), F.col("bucket").cast("long").alias("at"), F.explode(rows).alias("r")).select("part", "of", "at", "r.*")


def two_site_rates(pairs: DataFrame, species: DataFrame, kinetics: Kinetics, order: Column) -> DataFrame:
    """Recombinations forward, dissociative adsorptions both ways; pairs that name an unknown species give nothing."""
    bits = species.select("species", "bit")
    a, b = bits.select(F.col("species").alias("species_a"), F.col("bit").alias("_a")), bits.select(F.col("species").alias("species_b"), F.col("bit").alias("_b"))
    both = pairs.join(a, "species_a").join(b, "species_b")
    ea, e = F.col("ea_mev") / 1000.0, F.col("energy_mev") / 1000.0
    k = lambda x: X.rate(x, kinetics.nu, kinetics.temperature)
    full_a, full_b, none = F.shiftleft("_a", 8), F.shiftleft("_b", 8), F.lit(0)
    rows = F.when(
        F.col("is_dissociative"),
        F.array(_row(0, k(ea), F.col("_a"), F.col("_b"), True, none, "dissociative_pair"), _row(1, k(X.reverse_ev(ea, e)), full_a, full_b, True, none, "dissociative_pair")),
    ).otherwise(F.array(_row(0, k(ea), full_a, full_b, True, none, "recombination")))
    return both.select(F.lit(1).alias("part"), F.lit("").alias("of"), order.cast("long").alias("at"), F.explode(rows).alias("r")).select("part", "of", "at", "r.*")


def catalogue(rates: DataFrame) -> DataFrame:
    """schemas.REACTIONS with category: rates rescaled to the largest, numbered by bin_id, then order of emission.

    Two-site records give a row or two each, so rates can be many: the largest
    is an aggregate, and numbers come from ranges.
    """
    placed = numbered(rates, ["bin_id", "part", "of", "at", "emit"], "_place")
    top = F.broadcast(placed.agg(F.max("k").alias("_top")))  # one row
    scaled = placed.crossJoin(top).withColumn("rate_q16", X.rescaled_q16(F.col("k"), F.col("_top")))
    return scaled.select((F.col("_place") - 1).cast("int").alias("reaction_id"), "rate_q16", "bin_id", "transition_a", "transition_b", "is_bimolecular", "category")


def build(records: DataFrame, pairs: DataFrame, species: DataFrame, metal=None, facet=None, kinetics: Kinetics = Kinetics(), order: list[Column] | None = None) -> DataFrame:
    """The whole build: filters with fallback, buckets, rates, rescaling."""
    from .records import pairs_with_fallback, quantile_buckets, with_fallback

    own = pairs_with_fallback(pairs, metal, facet)
    buckets = quantile_buckets(with_fallback(records, metal, facet), order or [F.col("sid")])
    return catalogue(one_site_rates(buckets, species, own, kinetics).unionByName(two_site_rates(own, species, kinetics, F.col("sid"))))


def category_counts(reactions: DataFrame) -> DataFrame:
    return reactions.groupBy("category").agg(F.count("*").alias("reactions"))


def blocks(reactions: DataFrame) -> DataFrame:
    """reactions with block and lane, as files hold them."""
    block, lane = X.block_and_lane(F.col("reaction_id"), LANES)
    return reactions.withColumn("block", block).withColumn("lane", lane)


def magnitude_bins(reactions: DataFrame) -> DataFrame:
    """(bin_id, first_id, n, total) of a static catalogue's bins; total is the Q32.32 sum of their rates."""
    return reactions.groupBy("bin_id").agg(F.min("reaction_id").alias("first_id"), F.count("*").alias("n"), F.least(F.sum(F.col("rate_q16").cast("decimal(20,0)")) * 65536, F.lit(str(2**64 - 1)).cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"))


def usable_bin_at_or_below(bins: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (bin) with the nearest bin at or below it that has reactions and a positive total, else null."""
    marks = bins.where("n > 0 and total > 0").select(F.col("bin_id").alias("at"), F.col("bin_id").alias("usable"), F.lit(0).alias("side"))
    asked = wanted.select(F.col("bin").alias("at"), F.lit(None).cast("int").alias("usable"), F.lit(1).alias("side"))
    found = last_known(marks.unionByName(asked), [], ["at", "side"], {"nearest": "usable"})
    return found.where("side = 1").select(F.col("at").alias("bin"), F.col("nearest").alias("usable"))


def demo_catalogue(spark: SparkSession, count: int, seed: int = 0xC0FFEE00C0FFEE00) -> DataFrame:
    """schemas.REACTIONS of count reactions, rounded up to whole blocks: each from one 64-bit draw, cut into fields."""
    lanes = max(1, -(-count // LANES)) * LANES
    raw = splitmix.with_draw(spark.range(1, lanes + 1), "raw", seed, F.col("id"))
    bits = lambda at, width: F.shiftrightunsigned("raw", at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    cut = raw.select(
        "id",
        F.greatest(F.col("raw").bitwiseAND(F.lit(0xFFFFFF)), F.lit(1)).alias("rate_q16"),
        X.pack_transition(bits(24, 3), bits(27, 3)).alias("transition_a"),
        (bits(30, 3) == 0).alias("is_bimolecular"),
        X.pack_transition(bits(33, 3), bits(36, 3)).alias("_b"),
    )
    made = cut.withColumn("bin_id", X.magnitude_class(F.col("rate_q16"))).withColumn("transition_b", F.when(F.col("is_bimolecular"), F.col("_b")).otherwise(0))
    placed = numbered(made, ["bin_id", "id"], "_place")
    return placed.select((F.col("_place") - 1).cast("int").alias("reaction_id"), "rate_q16", "bin_id", "transition_a", "transition_b", "is_bimolecular")
