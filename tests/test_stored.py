"""Page chains, stored tables, appended coverage and the choice by one sweep."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from adlayer.operators import appended, choose, replay
from adlayer.operators.ordered import numbered
from adlayer.sources import landing


def chain(spark, rows):
    return landing.chained(spark.createDataFrame(rows, "after string, end string, more boolean, tag int").repartition(3))


def test_pages_in_order(spark):
    names = [f"c{random.Random(i).random()}" for i in range(37)]
    rows = [(names[i - 1] if i else None, names[i], i < 36, i) for i in range(37)]
    random.Random(1).shuffle(rows)
    assert all(r["page"] == r["tag"] for r in chain(spark, rows).collect())
    assert [r["page"] for r in chain(spark, [(None, "", False, 0)]).collect()] == [0] and chain(spark, []).count() == 0
    assert chain(spark, [(None, "", True, 0), ("", "x", False, 1)]).count() == 2  # an empty cursor isn't the first page's
    one = lambda *x: [(a, b, m, 0) for a, b, m in x]
    for bad, what in (
        (one((None, "a", True), ("b", "c", False)), "no page follows the cursor: a"),
        (one((None, "a", True), ("a", "b", True), ("a", "b", False)), "asked after one cursor: a"),
        (one(("z", "a", True), ("a", "b", False)), "no page ends at the cursor: z"),
        (one((None, "a", True), ("a", "b", False), ("x", "y", True), ("y", "x", True)), "in a loop: \\+[xy]"),
        (one((None, "a", False), (None, "b", False)), "asked after one cursor"),
        (one(("b", "a", True), ("a", "b", True)), "no first page"),
    ):
        with pytest.raises(ValueError, match=what):
            chain(spark, bad).count()


def test_stored_nodes_are_filtered_in_the_scan(spark, tmp_path):
    nodes = spark.range(5000).selectExpr("cast(id AS string) AS id", "'{}' AS reactants", "'{}' AS products", "1.0D AS reactionEnergy", "1.0D AS activationEnergy", "concat('M', id % 7) AS surfaceComposition", "concat('f', id % 3) AS facet")
    landing.store_nodes(nodes.repartition(4), str(tmp_path / "n"))
    found = landing.read_nodes(spark, str(tmp_path / "n"), "M3", "f1")
    assert sorted(r["id"] for r in found.collect()) == sorted(str(i) for i in range(5000) if i % 7 == 3 and i % 3 == 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(surfaceComposition,M3)" in plan and "EqualTo(facet,f1)" in plan
    assert landing.read_nodes(spark, str(tmp_path / "n")).count() == 5000


def test_only_the_delta_is_shuffled(spark, tmp_path):
    rows = [(i % 40, f"v{i}", f"{i:04d}") for i in range(100)] + [(None, "none", "0")]
    new = [(i, f"n{i}", f"{i:04d}") for i in range(30, 60)] + [(59, None, "9999"), (30, "older", "0000")]
    kind = "sid long, tag string, id string"
    target = landing.store_by_key(spark.createDataFrame(rows, kind), "stored_test", str(tmp_path / "t"), buckets=8)
    delta = spark.createDataFrame(new, kind)
    got = landing.upsert_stored(target, delta)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, landing.upsert(spark.createDataFrame(rows, kind), delta).collect()), key=str)
    plan = landing.upsert_stored(target, delta)._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("Bucketed: true")
    assert "Exchange" not in plan[plan.index("SortMergeJoin") : scan] and plan.count("Exchange hashpartitioning") == 2  # the delta to its keys, and these to the buckets
    spark.sql("DROP TABLE stored_test")


def test_appended_coverage(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, float(i // 2), rng.randrange(12), rng.choice([1, 2, 256, 512, 3 * 256 + 4])) for i in range(95)]
    kind = "ord long, sim_time double, site_idx long, transition int"
    species = [("O", 1), ("CO", 2)]
    kept = appended.Coverage(spark, str(tmp_path / "c"), species, 10, 10, [1, 2, 4])
    assert [tuple(r) for r in kept.rows().collect()] == [(0, 0.0, 10, 0, 0, 0)]
    for end in (0, 34, 36, 70, 95):
        part = [r for r in rows[:end] if r[1] >= 17 * (end > 34)] if end <= 36 else rows[36 if end == 70 else 70 : end]
        part = rows[34:36] if end == 36 else part
        kept.append(spark.createDataFrame(part, kind))
        if end:
            log = numbered(spark.createDataFrame(rows[:end], kind), ["sim_time", "ord"])
            whole = replay.coverage_of(log, species, 10, 10, bits=[1, 2, 4])
            assert sorted(map(tuple, kept.rows().collect())) == sorted(map(tuple, whole.collect())), end
    assert kept.at(47).first()["event"] == 40
    with pytest.raises(ValueError, match="comes after the log"):
        kept.append(spark.createDataFrame([(99, 1.0, 0, 1)], kind))


def test_choice_with_nearly_all_weight_on_one(spark):
    weights = [1] * 50 + [10**9] + [1] * 50 + [0]
    choices = spark.createDataFrame(list(enumerate(weights)), "choice int, weight long")
    spans = choose.cumulative(choices, [], "choice", "weight")
    total = sum(weights)
    draws = spark.createDataFrame([(i, (i + 0.5) / total if i < 50 else (10**9 + i + 0.5) / total) for i in range(100)] + [(100, 0.5), (101, 0.0)], "draw int, u double")
    got = {r["draw"]: r["choice"] for r in choose.by_search(draws, spans).collect()}
    assert got == {i: i if i < 50 else i + 1 for i in range(100)} | {100: 50, 101: 0}
    assert got == {r["draw"]: r["choice"] for r in choose.by_range(draws, spans).collect()}
    few = choose.by_search(spark.range(3000).select(F.col("id").alias("draw"), (F.rand(1) * 0 + 0.5).alias("u")), spans)
    assert few.select("choice").distinct().count() == 1 and few.count() == 3000
