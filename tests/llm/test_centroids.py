"""Ball-tree clustering against plain assignment, and odd vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException

from adlayer.llm import centroids as c


def plain(rows, k, rounds, width, scale=64):
    """{vec_id: (cluster, distance)}, inertia and the last centroids."""
    v = np.array([[int(np.floor(scale * float(x))) for x in e] for _, e in rows], object)
    first = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"1:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), tuple(v[i])))[:k]
    at = [list(v[i]) for i in first]
    for r in range(rounds + 1):
        d = [[sum((x - y) ** 2 for x, y in zip(p, q)) for q in at] for p in v]
        to = [row.index(min(row)) for row in d]
        if r < rounds:
            for j in range(len(at)):
                own = [p for p, t in zip(v, to) if t == j]
                if own:
                    at[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((str(rows[i][0]), t, d[i][t]) for i, t in enumerate(to)), at


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_plain(spark, spread):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in middle[i % 6] + spread * rng.normal(size=8)]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(7, rows[7][1]), (None, rows[3][1])]
    got = c.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k=7, width=8).collect()
    want, at = plain(rows, 7, 3, 8)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == want
    sums = {}
    for _, t, d in want:
        sums[t] = sums.get(t, 0) + d
    assert {(r["cluster"], r["cluster_inertia"], r["inertia"]) for r in got} == {(t, s, sum(sums.values())) for t, s in sums.items()}
    assert {r["cluster"]: r["centroid_sha256"] for r in got} == {t: hashlib.sha256(",".join(map(str, at[t])).encode()).hexdigest() for t in sums}


def test_whole_balls():
    """Well apart, balls go whole; ties go to the smaller number."""
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-9, 9, (2000, 4)), rng.integers(991, 1009, (2000, 4))])
    tree = c.grow(points)
    assert (np.sort(tree.order) == np.arange(4000)).all() and (tree.sum[0] == points.sum(axis=0)).all()
    whole, rows, _ = c.assign(tree, np.array([[0, 0, 0, 0], [1000, 1000, 1000, 1000]]))
    assert sum((tree.end[n] - tree.begin[n]).sum() for n, _ in whole) == 4000 and not len(rows)
    assert sum(len(n) for n, _ in whole) < 10
    same = c.grow(np.ones((500, 2), np.int64))
    whole, rows, to = c.assign(same, np.array([[0, 1], [2, 1], [5, 5]]))
    assert len(rows) == 500 and (to == 0).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (2, None, "b"), (3, [], "c"), (4, [1.0], "d"), (5, [1.0, None], "e"), (6, [1.0, nan], "f"), (7, [-inf, 1.0], "g"), (8, [-0.001, 0.0], "h"), (8, [-0.001, 0.0], "h")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    got = {(r["vec_id"], r["distance"], r["inertia"]) for r in c.cluster(df, width=2).collect()}
    assert got == {(1, 0, 0), (8, 0, 0)}
    assert c.cluster(df.where("false"), width=2).count() == 0
    with pytest.raises(PySparkException, match="beyond the range"):
        c.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), width=2).count()
