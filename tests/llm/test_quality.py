"""Quality classifier: the linear-time identity, held-out accuracy, edge cases."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from adlayer.llm import quality

DATA = "/root/testdata/sf0.01"


def test_pairwise_sum_by_squares():
    rng = np.random.default_rng(0)
    fm = quality.FactorisationMachine(0.3, rng.normal(size=quality.N_FEATURES), rng.normal(size=(quality.N_FEATURES, 4)))
    at, x = np.array([3, 70, 900, 16_400]), np.array([0.5, 1.0, 2.0, 0.25])
    pairs = sum(fm.factors[i] @ fm.factors[j] * a * b for (i, a), (j, b) in itertools.combinations(zip(at, x), 2))
    assert np.isclose(fm.raw(at, x, np.array([0]))[0], 0.3 + fm.linear[at] @ x + pairs)


def test_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = quality.fit(docs.join(labels, "doc_id").where(fold != 0))
    got = quality.score(docs, model).join(labels, "doc_id").where(fold == 0).collect()
    good, bad = [r["score"] for r in got if r["label"]], [r["score"] for r in got if not r["label"]]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] for r in got if r["label"]]) > 0.97
    again = quality.fit(docs.repartition(3).join(labels, "doc_id").where(fold != 0))
    assert np.array_equal(again.factors, model.factors)


def test_edge_cases(spark):
    rows = [(1, "good plain words here", 1), (2, "BAD!! BAD!! BAD!!", 0), (3, None, 1), (4, "", 0), (5, "word " * 200_000, 1), (6, "x", None), (2, "BAD!! BAD!! BAD!!", 0), (None, "y z", 1)]
    docs = spark.createDataFrame([(i, t, "clash", y) for i, t, y in rows], "doc_id long, text string, score string, label int")
    got = quality.score(docs, quality.fit(docs))
    assert got.columns == ["doc_id", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    one = quality.score(docs, quality.fit(docs.where("label = 1"))).first()["score"]
    none = quality.score(docs, quality.fit(docs.where("label = 7"))).first()["score"]
    assert one > 0.9 and none == 0.5
    assert quality.score(docs.where("false"), quality.fit(docs)).count() == 0
