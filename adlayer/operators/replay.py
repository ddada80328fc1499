"""Event logs replayed into states and coverage, without a loop.

A transition clears its reactant's bits and sets its product's. For each bit,
a site's state after an event is what the last event that touched the bit
left: what is last within a range of the site's events, else what the ranges
before it left, so a busy site is no one task. Coverage over time is a running
sum of the changes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..schemas import VACANT
from .ordered import numbered, ranged, running_sums


def with_transitions(events: DataFrame, reactions: DataFrame, exact: bool = True, unknown: str = "error") -> DataFrame:
    """events (ord, sim_time, site_idx, reaction_id) with their transition; an unknown reaction is an error, or has none if unknown is "null".

    A two-site event is two rows of one time and reaction; the second, by ord,
    has the reaction's transition_b if exact, else transition_a like the first.
    """
    known = events.join(reactions.select("reaction_id", "transition_a", "transition_b", "is_bimolecular"), "reaction_id", "left")
    a = F.col("transition_a") if unknown == "null" else F.when(F.col("transition_a").isNull(), F.raise_error(F.concat(F.lit("unknown reaction "), F.col("reaction_id").cast("string"))).cast("int")).otherwise(F.col("transition_a"))
    if not exact:
        return known.withColumn("transition", a).select(*events.columns, "transition")
    twin = F.row_number().over(Window.partitionBy("sim_time", "reaction_id").orderBy("ord")) % 2 == 0
    return known.withColumn("transition", F.when(twin & F.col("is_bimolecular"), F.col("transition_b")).otherwise(a)).select(*events.columns, "transition")


def states(events: DataFrame, order: list[str], bits: list[int], initial: DataFrame | None = None) -> DataFrame:
    """events (site_idx, transition, ...) with the site's state before and after each, in the order given.

    bits: all bits that may occur. initial: (site_idx, state) at the start, all
    vacant by default.
    """
    begun = events if initial is None else events.join(initial.select("site_idx", F.col("state").alias("_start")), "site_idx", "left")
    start = F.lit(0) if initial is None else F.coalesce("_start", F.lit(0))
    product, reactant = X.product_of(F.col("transition")), X.reactant_of(F.col("transition"))
    touch = lambda bit: F.when(product.bitwiseAND(F.lit(bit)) != 0, F.lit(bit)).when(reactant.bitwiseAND(F.lit(bit)) != 0, F.lit(0))
    names = {bit: f"_touch_{bit}" for bit in bits}
    dealt = ranged(begun.withColumns({names[bit]: touch(bit) for bit in bits}), ["site_idx", *order])
    # what each range's part of a site leaves, and so what the next begins with
    ends = dealt.groupBy("site_idx", "_range").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_in"))).alias(n) for n in names.values()))
    before = Window.partitionBy("site_idx").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("site_idx", "_range", *(F.last(n, ignorenulls=True).over(before).alias(f"{n}_before") for n in names.values()))
    site = Window.partitionBy("site_idx", "_range").orderBy("_in")
    upto = site.rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({f"{n}_in": F.last(n, ignorenulls=True).over(upto) for n in names.values()}).join(ends, ["site_idx", "_range"])

    def state(last: Callable[[str], list[Column]]) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), (F.coalesce(*last(n), start.bitwiseAND(F.lit(bit))) for bit, n in names.items()))

    done = placed.withColumn("state_after", state(lambda n: [F.col(f"{n}_in"), F.col(f"{n}_before")]))
    done = done.withColumn("_begin", state(lambda n: [F.col(f"{n}_before")]))
    done = done.withColumn("state_before", F.coalesce(F.lag("state_after").over(site), F.col("_begin")))
    return done.select(*events.columns, "state_before", "state_after")


def final_lattice(replayed: DataFrame, order: list[str], sites: int | None = None) -> DataFrame:
    """(site_idx, state) after the last event of each site; with sites, of all of them."""
    last = replayed.groupBy("site_idx").agg(F.max_by("state_after", F.struct(*order)).alias("state"))
    if sites is None:
        return last
    return replayed.sparkSession.range(sites).select(F.col("id").alias("site_idx")).join(last, "site_idx", "left").fillna(VACANT, ["state"])


def coverage(events: DataFrame, reactions: DataFrame, species: list[tuple[str, int]], sites: int, every: int = 10_000, exact: bool = True, initial: DataFrame | None = None, bits: list[int] | None = None) -> DataFrame:
    """(event, sim_time, vacant, a column for each species): counts of sites at the start, after each `every` events and after the last.

    events: schemas.EVENTS in file order. Events are numbered by time, ord
    among equal times; those of sites outside the lattice are numbered but
    change nothing. If exact, a sample due on such an event is still given, and
    other counts sites in none of the species' states; else neither is.
    """
    placed = numbered(events, ["sim_time", "ord"])
    return coverage_of(with_transitions(placed, reactions, exact), species, sites, every, exact, initial, bits)


def coverage_of(placed: DataFrame, species: list[tuple[str, int]], sites: int, every: int, exact: bool = True, initial: DataFrame | None = None, bits: list[int] | None = None) -> DataFrame:
    """coverage() of events (n, sim_time, site_idx, transition) that are numbered from 1 on."""
    inside = placed.where((F.col("site_idx") >= 0) & (F.col("site_idx") < sites))
    replayed = states(inside, ["n"], bits or [b for _, b in species], initial)
    wanted = [("vacant", VACANT), *species]
    change = lambda s: (F.col("state_after") == s).cast("long") - (F.col("state_before") == s).cast("long")
    sample = F.ceil(F.col("n") / every).cast("long")
    deltas = replayed.groupBy(sample.alias("sample")).agg(*(F.sum(change(s)).alias(name) for name, s in wanted))
    ends = placed.groupBy(sample.alias("sample")).agg(F.max("n").alias("event"), F.max_by("sim_time", "n").alias("sim_time"), F.max_by(F.col("site_idx").between(0, sites - 1), "n").alias("_inside"))
    if initial is None:
        begin = [F.lit(sites if s == VACANT else 0) for _, s in wanted]
        first = placed.sparkSession.range(1).select(*(c.cast("long").alias(name) for c, (name, _) in zip(begin, wanted)))
    else:
        known = initial.where(F.col("site_idx") < sites)
        first = known.agg(*((F.count_if(F.col("state") == s) + (F.lit(sites) - F.count("*") if s == VACANT else F.lit(0))).cast("long").alias(name) for name, s in wanted))
    start = first.select(F.lit(0).cast("long").alias("sample"), F.lit(0).cast("long").alias("event"), F.lit(0.0).alias("sim_time"), F.lit(True).alias("_inside"), *(n for n, _ in wanted))
    rows = ends.join(deltas, "sample", "left").select("sample", "event", "sim_time", "_inside", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n, _ in wanted)).unionByName(start)
    summed = running_sums(rows, [], ["sample"], {f"_sum_{n}": n for n, _ in wanted}).select("event", "sim_time", "_inside", *(F.col(f"_sum_{n}").alias(n) for n, _ in wanted))
    if exact:
        return summed.drop("_inside").withColumn("other", F.lit(sites).cast("long") - sum(F.col(n) for n, _ in wanted))
    return summed.where("_inside").drop("_inside")
