"""MinHash near-duplicates against all pairs, what keys guarantee, and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from adlayer.llm import minhash as m


def shingles(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    """(doc_id, size, least id) by all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(s), least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(3)
        at = rng.randrange(len(out))
        out[at : at + (k != 1)] = [] if k == 0 else [f"x{rng.randrange(9999)}"]
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_all_pairs(spark, width, percent):
    rng = random.Random(width)
    rows, base = [], [[f"w{rng.randrange(500)}" for _ in range(n)] for n in (4, 9, 30, 60, 200, 200)]
    for b in base:
        for n in range(30):
            rows.append((len(rows), " ".join(edited(rng, b, rng.randrange(1 + len(b) // 15)))))
    shared = [f"s{i}" for i in range(80)]  # members of many groups that don't link
    rows += [(1000 + i, " ".join(shared + [f"t{i}_{j}" for j in range(30)])) for i in range(40)]
    chain = [f"c{i}" for i in range(100)]  # each links with the next, the ends don't
    rows += [(2000 + i, " ".join([f"d{j}" for j in range(3 * i)] + chain[3 * i :])) for i in range(20)]
    rows += [(3000, "One two THREE"), (3001, "one  two\tthree"), (3002, "one two"), (3003, "one two"), (3004, "one")]
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width, percent, block=16)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, width, percent)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b c", "z"), (3, "a b c", "z"), (3, "other words here", None), (3, "other words here", None), (None, "null only id", "q"), (4, "é " * 3000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in m.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (None, 1, 3), (3, 1, 3), (3, 1, 3), (3, 1, 3), (None, 1, None), (4, 1, 4)], key=str)
    alike = {(r["doc_id"], r["component_id"]) for r in m.near_duplicates(docs.where("doc_id < 3"), empty_alike=True).collect()}
    assert alike == {(1, 1), (2, 1)}
    assert m.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("symbols,distance,errors", [(64, 31, 1), (64, 36, 1), (20, 7, 2), (8, 7, 0), (4, 0, 1)])
def test_keys_meet(symbols, distance, errors):
    """Two signatures within the distance agree in all places of some key."""
    places = m.chunks(symbols, distance, errors)
    rng = random.Random(symbols)
    for _ in range(300):
        wrong = set(rng.sample(range(symbols), min(distance, symbols)))
        assert any(not wrong & set(p) for p in places)
    assert {x for p in places for x in p} == set(range(symbols))


def test_threshold_and_signatures():
    assert m.threshold(64, 100) == 0 and m.threshold(64, 85) < m.threshold(64, 80) < 64
    sign, rng = m.Signatures(64), np.random.default_rng(5)
    apart = []
    for _ in range(300):
        both = rng.integers(-(2**63), 2**63 - 1, 20)
        a, b = np.sort(both[:17]), np.sort(both[3:])  # 14 of 20 are common
        apart.append((sign(a) != sign(b)).mean())
    assert abs(np.mean(apart) - 0.3) < 0.01
    assert (sign(np.arange(5000)) == sign(np.arange(5000))).all()
