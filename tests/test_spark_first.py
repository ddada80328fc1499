"""Neighbours by halo exchange, quantile cuts from sketches, and the log as a stream, each against plain code."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from adlayer.operators import lattice as L
from adlayer.operators import records as R
from adlayer.sources import config as cfg
from adlayer.streaming import replay


def steps(row, col):
    s = row % 2
    return [(row, col - 1), (row, col + 1), (row - 1, col - 1 + s), (row - 1, col + s), (row + 1, col - 1 + s), (row + 1, col + s)]


@pytest.mark.parametrize("parts,block", [(1, 1 << 20), (5, 1 << 20), (3, 40)])
@pytest.mark.parametrize("in_order", [True, False])
def test_halo(spark, monkeypatch, parts, block, in_order):
    monkeypatch.setattr(L, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 25)
    try:
        rng, width, height, patches = random.Random(parts), 7, 23, 3
        state = {i: rng.choice([0, 0, 1, 2, 4]) for i in range(width * height) if rng.random() < 0.95}  # some sites have no row
        rows = list(state.items())
        lattice = spark.createDataFrame(rows if in_order else rng.sample(rows, len(rows)), "site_idx long, state int")
        lattice = lattice.coalesce(1).repartitionByRange(parts, "site_idx") if in_order else lattice.repartition(parts)
        placed = L.with_patches(lattice, width, height, patches)
        per = -(-height // patches)
        pairs, first = Counter(), {}
        for i, a in state.items():
            for k, (r, c) in enumerate(steps(i // width % per, i % width)):
                own = i // width // per
                if 0 <= r < min(per, height - own * per) and 0 <= c < width and (j := (own * per + r) * width + c) in state:
                    b = state[j]
                    pairs[own, min(a, b), max(a, b)] += i < j
                    if (a, b) == (1, 2) and (own, i) not in first:
                        first[own, i] = j
        got = {(r["patch_id"], r["low"], r["high"]): r["n"] for r in L.pair_counts(placed, width).collect()}
        assert got == {k: n for k, n in pairs.items() if n}
        found = {(r["patch_id"], r["a"]): r["b"] for r in L.pair_candidates(placed, width, 1, 2).collect()}
        assert found == {(p, i - p * per * width): j - p * per * width for (p, i), j in first.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_only_edges_are_shuffled(spark):
    lattice = spark.range(0, 100 * 1000, 1, 4).select(F.col("id").alias("site_idx"), (F.col("id") % 3).cast("int").alias("state"))
    halo = L._halo(L.with_patches(lattice, 100, 1000), 100, L._counted)
    assert halo.where("kind > 0").count() <= 3 * (2 * 100 + 100 + 2)  # three seams of two edges each, a row of sites
    dealt = L.by_site(L.with_patches(lattice.repartition(4), 100, 1000))
    assert L._halo(dealt, 100, L._counted).where("kind > 0").count() < 4000


def plain_buckets(rows, buckets):
    out = {}
    for species in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r for r in rows if r[0] == species), key=lambda r: (r[1] is not None, r[1] or 0, r[3]))
        n = len(own)
        for rank, r in enumerate(own):
            of = min(buckets, n)
            out.setdefault((species, ((rank + 1) * of - 1) // n), []).append(r)
    mean = lambda v: sum(v) / len(v) if v else None
    return {k: (len(v), mean([r[1] for r in v if r[1] is not None] or []) if all(r[1] is not None for r in v) else "null", mean([r[2] for r in v if r[2] is not None])) for k, v in out.items()}


@pytest.mark.parametrize("kind", ["even", "ties", "skewed", "few"])
def test_quantile_cuts(spark, kind):
    rng = random.Random(kind)
    rows = []
    for i in range(6000):
        e = {"even": rng.randrange(-(10**6), 10**6), "ties": rng.choice([5, 5, 5, 5, 7, 9]), "skewed": int(rng.gauss(0, 1) ** 5 * 1000), "few": rng.randrange(9)}[kind]
        species = "big" if rng.random() < 0.8 else rng.choice(["a", "b", f"one{i}", None]) if kind != "few" else f"s{i % 2500}"
        rows.append((species, e, rng.choice([None, rng.randrange(100)]), i))
    df = spark.createDataFrame(rows, "species string, energy_mev int, real_ea_mev int, sid long").repartition(5)
    got = {(r["species"], r["bucket"]): (r["n"], r["mean_energy_mev"], r["mean_ea_mev"]) for r in R.quantile_buckets(df, [F.col("sid")]).collect()}
    assert got == plain_buckets(rows, 4)
    assert R.quantile_buckets(df, [F.col("sid")], 1).count() == len({r[0] for r in rows} - {None})


def test_few_rows_are_ranked(spark, monkeypatch):
    """Of energies that differ, a few thousandths are near a cut."""
    seen = []
    monkeypatch.setattr(R, "numbered", lambda df, *a: seen.append(df.count()) or numbered(df, *a))
    from adlayer.operators.ordered import numbered

    df = spark.range(200_000).selectExpr("id % 3 AS species", "cast(hash(id) AS int) AS energy_mev", "cast(NULL AS int) AS real_ea_mev", "id AS sid")
    got = R.quantile_buckets(df, [F.col("sid")])
    assert got.count() == 12 and 0 < seen[0] < 200_000 * 0.02
    assert R.quantile_buckets(df.where("false"), [F.col("sid")]).count() == 0
    empty = R.quantile_buckets(spark.createDataFrame([("x", None, 3, 1), ("x", 5, None, 2)], "species string, energy_mev int, real_ea_mev int, sid long"), [F.col("sid")]).collect()
    assert sorted((r["bucket"], r["n"], r["mean_energy_mev"], r["mean_ea_mev"]) for r in empty if r["bucket"] == 1) == [(1, 1, 5.0, None)] and len(empty) == 2


def applied(rows):
    state, out = {}, set()
    for t, o, s, x in sorted(rows):
        before = state.get(s, 0)
        state[s] = before & ~(x >> 8) | x & 255
        out.add((s, o, before, state[s]))
    return out


def test_stream_of_any_order(spark, tmp_path):
    """Files come one by one, rows at most 60 s late; what comes later is left out."""
    rng = random.Random(8)
    rows = [(10**11 + 1_000_000 * i + rng.randrange(3), i, rng.randrange(4), rng.choice([1, 2, 256, 512, 3 * 256 + 5])) for i in range(400)]
    rows += [(rows[7][0], 900, rows[7][2], 2)]  # one time, two events
    arrival = sorted(rows, key=lambda r: r[0] + rng.randrange(50_000_000))
    batches = [arrival[i : i + 100] for i in range(0, len(arrival), 100)]
    late = (10**11 + 2_000_000, 990, 1, 1)
    kind = "micros long, ord long, site_idx long, transition int"
    put = lambda part: spark.createDataFrame(part, kind).coalesce(1).selectExpr("ord", "timestamp_micros(micros) AS time", "site_idx", "transition").write.mode("append").parquet(str(tmp_path / "in"))
    put(batches[0])
    stream = spark.readStream.schema("ord long, time timestamp, site_idx long, transition int").parquet(str(tmp_path / "in"))
    query = replay.states(stream, "60 seconds").writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        sizes = []
        for part in [*batches[1:], [late], [(10**11 + 10**9, 1000, 99, 0)], [(10**11 + 2 * 10**9, 1001, 99, 0)]]:
            query.processAllAvailable()
            sizes.append(spark.table("states").count())
            put(part)
        query.processAllAvailable()
        got = {(r["site_idx"], r["ord"], r["state_before"], r["state_after"]) for r in spark.table("states").where("ord < 1000").collect()}
    finally:
        query.stop()
    assert got == applied(rows)
    assert sizes[1] < sizes[3] and sizes[2] > 0  # states are given out on the way


def test_configurations_in_rows(spark):
    rows = [(1, "[species]\nO = 1, -, -, -, molecular, 7\n[bimolecular]\nx = O, O, recombination, O2"), (2, "bad"), (3, None), (4, "")]
    df = cfg.parsed(spark.createDataFrame(rows, "id int, text string"), "text")
    got = {r["id"]: r for r in df.collect()}
    assert got[1]["species"][0]["oc20_ads_id"] == 7 and got[1]["bimolecular"][0]["species_b"] == 0 and got[1]["error"] is None
    assert "equals sign" in got[2]["error"] and got[2]["species"] is None and got[3]["species"] == [] and got[4]["error"] is None
    assert cfg.parsed(spark.createDataFrame([], "id int, text string"), "text").count() == 0
    at = lambda named, older: df.where("id = 1").select(cfg.pressures_of("species", named, older)).first()[0]
    none = F.lit(None).cast("map<string,double>")
    own = lambda name, p: F.create_map(F.lit(name), F.lit(p))
    assert (at(none, none), at(own("O", 2.0), own("O", 3.0)), at(none, own("O", 3.0)), at(none, own("X", 3.0))) == ({"O": 1.0}, {"O": 2.0}, {"O": 3.0}, {"O": 1.0})
    for bad in ((own("X", 2.0), none), (own("O", -1.0), none)):
        with pytest.raises(Exception, match="pressure"):
            at(*bad)


def test_blocks_of_sites_are_bounded_whatever_the_batches():
    n, sizes = 300_000, []
    site = np.arange(n)
    batch = pa.RecordBatch.from_pydict({"patch_id": np.zeros(n, np.int64), "site": site, "state": site % 3, "rows": np.full(n, n // 50)})

    def inner(block):
        sizes.append(len(block.site))
        yield from L._counted(block)

    rows = pa.Table.from_batches(list(L._blocks(50, inner)(iter([batch])))).to_pandas()
    assert sum(sizes) == n and max(sizes) <= 1 << 17
    known = rows[rows["kind"] == 0]
    a, b = rows[rows["kind"] == 1], rows[rows["kind"] == 2]
    r, c = np.divmod(site, 50)
    want = 0
    for down, even, odd in [L._STEPS[i] for i in L._FORWARD]:
        to_r, to_c = r + down, c + np.where(r % 2 == 1, odd, even)
        want += int(((to_r < n // 50) & (to_c >= 0) & (to_c < 50)).sum())
    assert known["n"].sum() + len(a) == want and set(a["other"]) <= set(b["site"])


def test_calls_to_the_store_follow_buckets(spark):
    """A batch's events of a bucket are one entry, and an earlier timer replaces the later one."""
    class Value:
        def __init__(self):
            self.held, self.calls = None, 0

        def get(self):
            return self.held

        def update(self, x):
            self.held = x

        def clear(self):
            self.held = None

    class Items(Value):
        def get(self):
            return iter(self.held or [])

        def put(self, x):
            self.held = list(x)

        def appendValue(self, x):
            self.calls += 1
            self.held = [*(self.held or []), x]

        def appendList(self, x):
            self.calls += len(x)
            self.held = [*(self.held or []), *x]

    class Handle:
        def __init__(self):
            self.timers = []
            self.getValueState = lambda *a: Value()
            self.getListState = lambda *a: Items()

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 10**9)

    handle, own = Handle(), replay._Replay()
    own.init(handle)
    rows = [(1_000 * (200 - i), i, i % 5, (1, 2, 256, 512)[i % 4]) for i in range(200)]
    for part in (rows[:100], rows[100:]):
        frame = pd.DataFrame(part, columns=["micros", "ord", "site_idx", "transition"])
        list(own.handleInputRows((0,), iter([frame[:50], frame[50:]]), None))
    assert own.waiting.calls == 2 and len(handle.timers) == 1
    got = pd.concat(list(own.handleExpiredTimer((0,), Times, None)))
    assert {(r.site_idx, r.ord, r.state_before, r.state_after) for r in got.itertuples()} == applied(rows)
