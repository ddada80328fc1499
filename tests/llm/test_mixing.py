"""Mixing: water levels against a loop, taken words against targets, edge cases."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adlayer.llm import mixing


def loop(sizes, weights, epochs=3):
    """Clamp and share again until none is above its cap."""
    capped = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped and sizes[i]]
        left = sum(sizes) - sum(capped.values())
        level = left / sum(weights[i] for i in free) if free else 0
        over = [i for i in free if level * weights[i] > epochs * sizes[i]]
        if not over:
            return [capped.get(i, level * weights[i] if sizes[i] else 0.0) for i in range(len(sizes))]
        capped |= {i: epochs * sizes[i] for i in over}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8))
def test_levels(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    weights = mixing.weigh_in_turn(rows)
    got = {r["source"]: r["target"] for r in mixing.fill(rows, weights).collect()}
    want = loop(sizes, [i % 3 + 1 for i in range(len(sizes))])
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def docs(spark):
    rows = [(i, "w " * (i % 50 + 1), "abc"[0 if i % 3 else (i // 3) % 3]) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_taken_words(spark):
    got = mixing.mix(docs(spark)).collect()
    again = mixing.mix(docs(spark).repartition(3)).collect()
    assert sorted(got) == sorted(again) and len(got) == 3000
    by = {}
    for r in got:
        assert r["taken"] == r["repeats"] * r["size"] <= 3 * r["size"]
        by.setdefault((r["source"], r["target"], r["source_size"]), []).append(r)
    assert len(by) == 3
    for (_, target, size), rows in by.items():
        assert sum(r["size"] for r in rows) == size and abs(sum(r["taken"] for r in rows) - target) <= 50


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "x\u00a0y z", None), (4, "x\u00a0y z", None), (None, "q", "b"), (5, "long " * 200_000, "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["size"] for r in got} == {1: 0, 2: 0, 3: 0, 4: 2, None: 1, 5: 200_000}
    assert all(r["repeats"] <= 3 for r in got)
    assert all(r["target"] == 0 and r["taken"] == 0 for r in got if r["source"] == "a")
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
