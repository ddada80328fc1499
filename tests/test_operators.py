"""Operators on small literals and against plain loops."""

from __future__ import annotations

import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adlayer.functions import expressions as X
from adlayer.functions import splitmix
from adlayer.operators import catalogue as C
from adlayer.operators import choose, ordered, replay, report
from adlayer.operators import lattice as L
from adlayer.operators import records as R
from adlayer.plans.queries import CONFIG
from adlayer.sources import config as cfg
from adlayer.sources import landing
from adlayer.streaming import events as S

RECORDS = "species string, energy_mev int, sid long, real_ea_mev int, metal string, facet int"
PAIRS = "species_a string, species_b string, energy_mev int, sid long, ea_mev int, metal string, facet int, is_dissociative boolean"
SPECIES = [("O", 1, "dissociative"), ("H", 4, "dissociative"), ("CO", 2, "molecular"), ("OH", 8, "product_only")]


def species(spark):
    return spark.createDataFrame(SPECIES, "species string, bit int, role string")


# Records


def buckets(spark, energies, barriers=None, k=4):
    rows = [("O", e, i, barriers[i] if barriers else None, "Pd", 111) for i, e in enumerate(energies)]
    got = R.quantile_buckets(spark.createDataFrame(rows, RECORDS), [F.col("sid")], k).orderBy("bucket").collect()
    return [(r["n"], r["mean_energy_mev"], r["mean_ea_mev"]) for r in got]


def test_buckets_of_literals(spark):
    assert buckets(spark, [5, 1, 7, 0, 3, 6, 2, 4]) == [(2, x, None) for x in (0.5, 2.5, 4.5, 6.5)]
    assert buckets(spark, [1, 2, 3], [100, None, 300], 1) == [(3, 2.0, 200.0)]
    assert [n for n, _, _ in buckets(spark, [9, 9])] == [1, 1]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=30), st.integers(1, 6))
def test_bucket_bounds(spark, energies, k):
    ordered_, of = sorted(energies), min(k, len(energies))
    n = len(energies)
    want = [ordered_[b * n // of : (b + 1) * n // of] for b in range(of)]
    assert [(c, e) for c, e, _ in buckets(spark, energies, k=k)] == [(len(w), sum(w) / len(w)) for w in want]


def test_fallback(spark):
    rows = [("O", 1, 1, None, "Pd", 111), ("O", 2, 2, None, "Pd", 100), ("O", 3, 3, None, "Pt", 111)] + [("H", i, 10 + i, None, "Pd", 111) for i in range(4)] + [("H", 9, 20, None, "Pd", 100)]
    df = spark.createDataFrame(rows, RECORDS)
    sids = lambda d: sorted(r["sid"] for r in d.collect())
    assert sids(R.with_fallback(df, "Pd", 111)) == [1, 2, 10, 11, 12, 13]
    assert sids(R.with_fallback(df, "Pd", None)) == [1, 2, 10, 11, 12, 13, 20]
    assert len(sids(R.with_fallback(df, None, 111))) == len(rows)
    with pytest.raises(ValueError):
        R.require_rows(df.where("false"))


def test_pair_fallback_is_over_all(spark):
    df = spark.createDataFrame([("O", "CO", 1, 1, 1, "Pd", 100, False), ("H", "H", 1, 2, 1, "Pd", 111, False)], PAIRS)
    assert R.pairs_with_fallback(df, "Pd", 111).count() == 1 and R.pairs_with_fallback(df, "Pd", 211).count() == 2 and R.pairs_with_fallback(df, "Pt", 111).count() == 0


# The catalogue


def build(spark, records, pairs):
    return C.build(spark.createDataFrame(records, RECORDS), spark.createDataFrame(pairs, PAIRS), species(spark)).orderBy("reaction_id").collect()


def test_molecular_species_get_both_directions(spark):
    got = build(spark, [("CO", -100 * i, i, None, "Pd", 111) for i in range(12)], [])
    assert sorted(r["category"] for r in got) == ["adsorption"] * 4 + ["desorption"] * 4
    assert max(r["rate_q16"] for r in got) == 2**31 and [r["bin_id"] for r in got] == sorted(r["bin_id"] for r in got)


def test_recombination_replaces_desorption(spark):
    got = build(spark, [("H", -500, i, None, "Pd", 111) for i in range(4)], [("H", "H", -33, 99, 350, "Pd", 111, False)])
    assert sorted(r["category"] for r in got) == ["dissociative_adsorption"] * 4 + ["recombination"]


def test_dissociative_pairs_go_both_ways(spark):
    got = build(spark, [], [("H", "OH", 220, 42, 1011, "Pd", 111, True)])
    assert [(r["transition_a"], r["transition_b"]) for r in got] == [(4, 8), (4 * 256, 8 * 256)] and got[1]["rate_q16"] > got[0]["rate_q16"]


def test_full_counts(spark):
    """O 6, H 9, CO 3, H2O 4 records and two water splittings give 34 reactions, 7 + 15 + 8 + 4."""
    rows = [(s, -i, 100 * k + i, None, "Pd", 111) for k, (s, n) in enumerate((("O", 6), ("H", 9), ("CO", 3), ("H2O", 4))) for i in range(n)]
    known = spark.createDataFrame([*SPECIES, ("H2O", 16, "molecular")], "species string, bit int, role string")
    pairs = spark.createDataFrame([("H", "OH", 1, i, 2, "Pd", 111, True) for i in range(2)], PAIRS)
    counts = {r["category"]: r["reactions"] for r in C.category_counts(C.build(spark.createDataFrame(rows, RECORDS), pairs, known)).collect()}
    assert counts == {"adsorption": 7, "desorption": 15, "dissociative_adsorption": 8, "dissociative_pair": 4}


def test_no_rates_and_unknown_species(spark):
    assert build(spark, [("OH", 1, 1, None, "Pd", 111)], [("O", "XX", 1, 1, 1, "Pd", 111, False)]) == []


# Expressions and draws


def test_rounding_and_transitions(spark):
    row = spark.createDataFrame([(0.0005, 0.0015, -0.0025, 5)], "a double, b double, c double, s int").select(X.mev_from_ev(F.col("a")).alias("a"), X.mev_from_ev(F.col("b")).alias("b"), X.mev_from_ev(F.col("c")).alias("c"), X.apply_transition(F.col("s"), F.lit(4 * 256 + 2)).alias("t")).first()
    assert tuple(row) == (0, 2, -2, 3)


def test_fixed_point(spark):
    big = F.lit(str(2**64 - 1)).cast("decimal(38,0)")
    row = spark.range(1).select(X.fixed_add(big, big).cast("string").alias("a"), X.fixed_to_double(X.fixed_from_q16(F.lit(65536))).alias("b"), X.bin_ceiling(F.lit(60)).alias("c"), X.magnitude_class(F.lit(2**24 - 1)).alias("d")).first()
    assert tuple(row) == (str(2**64 - 1), 1.0, 2.0**63, 23)


def test_draws_are_the_stream(spark):
    for seed in (0, 1, 0xC0FFEE00C0FFEE00, 2**64 - 1):
        got = splitmix.with_draw(spark.range(1, 20), "d", seed, F.col("id")).orderBy("id").collect()
        assert [r["d"] & (2**64 - 1) for r in got] == [splitmix.draw_of(seed, n) for n in range(1, 20)]
    below = splitmix.with_below(splitmix.with_draw(spark.range(1, 2000), "d", 3, F.col("id")), "b", "d", F.lit(1000))
    assert all(r["b"] == ((r["d"] & (2**64 - 1)) * 1000) >> 64 for r in below.collect())
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_site_classes_are_even(spark):
    counts = splitmix.with_site_bucket(spark.range(20_000), "b", F.col("id"), F.lit(4), 9).groupBy("b").count().collect()
    assert len(counts) == 4 and all(4000 < r["count"] < 6000 for r in counts)


# Lattices


def neighbours(spark, width, rows, site):
    df = spark.createDataFrame([(site // width, site % width)], "row long, col long").select(X.neighbours(F.col("row"), F.col("col"), width, rows).alias("n"))
    return [x["site"] for x in df.first()["n"]]


def test_neighbours(spark):
    assert neighbours(spark, 6, 6, 14) == [13, 15, 7, 8, 19, 20]
    assert neighbours(spark, 6, 6, 20) == [19, 21, 14, 15, 26, 27]
    assert neighbours(spark, 5, 5, 0) == [1, 5] and neighbours(spark, 1, 1, 0) == []


@pytest.mark.parametrize(("height", "patches", "want"), [(10, 4, (3, 4)), (5, 4, (2, 3)), (3, 9, (1, 3)), (7, 0, (7, 1))])
def test_bands(height, patches, want):
    assert L.bands(height, patches) == want


def grid(spark, states, width, patches=1):
    df = spark.createDataFrame(list(enumerate(states)), "site_idx long, state int")
    return L.with_patches(df, width, len(states) // width, patches)


def test_pair_counts_of_literals(spark):
    assert {(r["low"], r["high"]): r["n"] for r in L.pair_counts(grid(spark, [1, 2, 4, 4], 2), 2).collect()} == {(1, 2): 1, (4, 4): 1, (1, 4): 1, (2, 4): 2}


def test_edges_are_symmetric(spark):
    placed = grid(spark, [0] * 70, 7, 3)
    both = {(r["patch_id"], r["a"], r["b"]) for r in L.edges(placed, 7, forward=False).collect()}
    half = {(r["patch_id"], r["a"], r["b"]) for r in L.edges(placed, 7).collect()}
    assert both == half | {(p, b, a) for p, a, b in half} and not half & {(p, b, a) for p, a, b in half}


def test_corrupt_sites_and_layout(spark):
    placed = grid(spark, [0, 1, 2, 3, 8, 1], 3)
    assert sorted(r["site_idx"] for r in L.corrupt_sites(placed, 3).collect()) == [3, 4]
    labels = {r["site_idx"]: (r["x"], round(r["y"], 3), r["label"]) for r in report.hex_layout(placed, 3, {1: "O", 2: "CO"}).collect()}
    assert labels[3] == (0.5, 0.866, "corrupt") and labels[2] == (2.0, 0.0, "CO")


# Choice


def test_range_and_search_choose_alike(spark):
    spans = choose.cumulative(spark.createDataFrame([(i, w) for i, w in enumerate([5, 0, 1, 4])], "id int, w long"), [], "id", "w")
    draws = spark.createDataFrame([(x / 100,) for x in range(100)], "u double")
    a = {(r["u"], r["id"]) for r in choose.by_range(draws, spans).collect()}
    assert a == {(r["u"], r["id"]) for r in choose.by_search(draws, spans, slices=7).collect()}
    assert [sum(i == k for _, i in a) for k in range(4)] == [50, 0, 10, 40]


def test_pressure(spark):
    live = spark.createDataFrame([(0, 10, 0, 1, 0, False, 3), (1, 10, 0, 256, 0, False, 3), (2, 10, 0, 1, 2, True, 3), (3, 10, 0, 1, 1, True, 3)], "reaction_id int, rate_q16 long, bin_id int, transition_a int, transition_b int, is_bimolecular boolean, live long")
    assert [r["weight"] for r in L.propensities(live, {1: 2.0}).orderBy("reaction_id").collect()] == [60.0, 30.0, 30.0, 60.0]


# Order and replay


def test_numbering_and_running_sums(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "t int, k int").repartition(7)
    got = ordered.numbered(df, ["t", "k"]).collect()
    assert sorted((r["n"], r["t"], r["k"]) for r in got) == [(i + 1, *x) for i, x in enumerate(sorted(rows))]
    sums = ordered.running_sums(spark.range(300).selectExpr("id % 2 AS g", "id AS at", "id AS v").repartition(5), ["g"], ["at"], {"s": "v"}).collect()
    assert len(sums) == 300 and all(r["s"] == sum(x for x in range(r["at"] + 1) if x % 2 == r["g"]) for r in sums)
    marks = spark.range(300).selectExpr("id % 2 AS g", "id AS at", "if(id % 7 = 3, id, null) AS v").repartition(5)
    last = ordered.last_known(marks, ["g"], ["at"], {"x": "v"}).collect()
    assert all(r["x"] == max((x for x in range(r["at"] + 1) if x % 2 == r["g"] and x % 7 == 3), default=None) for r in last)


def test_hot_values_spread_over_ranges(spark):
    """One species, one energy and one site have nearly all rows; ranges still are about even."""
    rows = spark.range(20_000).selectExpr("'O' AS species", "if(id = 0, 1000000000, 5) AS energy_mev", "id AS sid")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in ordered.ranged(rows, ["species", "energy_mev", "sid"]).groupBy("_range").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 8_000
    events = spark.range(20_000).selectExpr("id AS n", "if(id % 100 = 0, id, 7) AS site_idx", "if(id % 3 = 0, 256, 1) AS transition")
    got = replay.states(events, ["n"], [1]).where("site_idx = 7").orderBy("n").collect()
    state = 0
    for r in got:
        assert r["state_before"] == state
        state = 0 if r["transition"] == 256 else 1
        assert r["state_after"] == state


REACTIONS = [(0, 1, 0, False), (1, 256, 0, False), (2, 2 * 256, 256, True), (3, 3 * 256, 6, True)]


@pytest.mark.parametrize("exact", [True, False])
def test_coverage_against_a_loop(spark, exact):
    rows, t = [], 0.0
    rng = random.Random(4)
    while len(rows) < 300:
        t += 0.25
        r = rng.randrange(4)
        for _ in range(1 + REACTIONS[r][3]):
            rows.append((len(rows), t, rng.randrange(12), r))
    events = spark.createDataFrame(rows, "ord long, sim_time double, site_idx long, reaction_id int").repartition(3)
    reactions = spark.createDataFrame(REACTIONS, "reaction_id int, transition_a int, transition_b int, is_bimolecular boolean")
    got = replay.coverage(events, reactions, [("O", 1), ("CO", 2)], 10, 7, exact, bits=[1, 2, 4]).orderBy("event").collect()
    state, want, seen = [0] * 10, [(0, 0.0, 10, 0, 0)], {}
    for n, (_, time, site, r) in enumerate(rows, 1):
        seen[time, r] = seen.get((time, r), 0) + 1
        if site < 10:
            _, a, b, two = REACTIONS[r]
            change = b if exact and two and seen[time, r] == 2 else a
            state[site] = (state[site] & ~(change >> 8)) | change & 255
        if (n % 7 == 0 or n == len(rows)) and (exact or site < 10):
            want.append((n, time, state.count(0), state.count(1), state.count(2)))
    assert [tuple(r)[:5] for r in got] == want
    if exact:
        assert all(r["other"] == 10 - r["vacant"] - r["O"] - r["CO"] for r in got)


def test_initial_lattice_and_unknown_reactions(spark):
    events = spark.createDataFrame([(0, 1.0, 2, 0)], "ord long, sim_time double, site_idx long, reaction_id int")
    reactions = spark.createDataFrame(REACTIONS, "reaction_id int, transition_a int, transition_b int, is_bimolecular boolean")
    start = spark.createDataFrame([(0, 1), (2, 2)], "site_idx long, state int")
    got = replay.coverage(events, reactions, [("O", 1), ("CO", 2)], 4, 5, initial=start).orderBy("event").collect()
    assert [tuple(r)[2:] for r in got] == [(2, 1, 1, 0), (2, 1, 0, 1)]
    with pytest.raises(Exception, match="unknown reaction 9"):
        replay.with_transitions(events.withColumn("reaction_id", F.lit(9)), reactions).collect()


# Landed records and reports


def test_pages(spark, tmp_path):
    node = {"id": "UmVhY3Rpb246NDQ4ODE1", "reactants": '{"star": 1, "NOgas": 1}', "products": '{"NOstar": 1}', "reactionEnergy": -1.2345, "activationEnergy": 0.5, "surfaceComposition": "Pd", "facet": "111"}
    page = lambda *nodes: json.dumps({"data": {"reactions": {"pageInfo": {"hasNextPage": False, "endCursor": "x"}, "edges": [{"node": n} for n in nodes]}}})
    (tmp_path / "p.json").write_text("\n".join([page(node, node | {"reactionEnergy": None, "id": "b"}), page(node, node | {"surfaceComposition": "Cu", "id": "c"})]))
    config = cfg.parse(CONFIG)
    nodes = landing.read_pages(spark, str(tmp_path / "p.json"))
    got = landing.clean_adsorptions(nodes, config).orderBy("sid").collect()
    assert [(r["species"], r["energy_mev"], r["sid"], r["metal"]) for r in got] == [(2, -1234, 0, 3), (2, -1234, 448815, 1)]
    assert landing.read_pages(spark, str(tmp_path / "p.json"), metal="Cu").count() == 1
    mono = landing.barriers(landing.categorised(nodes, config))
    assert mono.count() == 2 and landing.two_site(landing.categorised(nodes, config)).count() == 0
    merged = landing.upsert(landing.clean_adsorptions(nodes, config), mono)
    assert {r["sid"]: r["real_ea_mev"] for r in merged.collect()} == {0: 500, 448815: 500}
    (tmp_path / "e.json").write_text(json.dumps({"errors": "bad query"}))
    with pytest.raises(Exception, match="bad query"):
        landing.read_pages(spark, str(tmp_path / "e.json")).collect()


def test_coverage_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0.0, 4, 0), (10, 2e-6, 1, 3)], "event long, sim_time double, vacant long, O long")
    report.write_coverage_csv(rows, str(tmp_path / "c"))
    back = landing.read_coverage_csv(spark, str(tmp_path / "c"))
    assert sorted(back.collect()) == sorted(rows.collect())
    last = report.coverage_percent(back, ["vacant", "O"]).orderBy("event").collect()[1]
    assert tuple(last) == (10, 2.0, 25.0, 75.0) and not math.isnan(last["O"])


# Streams


def test_streams_give_what_batches_give(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = S.read_events(spark, str(tmp_path / "in"), source.schema)

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    batch = lambda df: sorted(map(tuple, df.collect()))
    assert run(S.windowed_counts(stream, "ts", "event_type", "1 hour", "30 days"), "w") == batch(S.windowed_counts(source, "ts", "event_type", "1 hour"))
    assert run(S.sessions(stream, "ts", "user_id", "6 hours", "30 days"), "s") == batch(S.sessions(source, "ts", "user_id", "6 hours"))
    assert batch(S.windowed_counts(source, "ts", "event_type", "2 hours", slide="1 hour"))
