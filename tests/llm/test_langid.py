"""Language identification: fixtures, edge cases, held-out accuracy."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlayer.llm import langid

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de")] * 4)]
    return langid.fit(spark.createDataFrame(rows, DOCS))


def test_known_words_decide(spark, model):
    rows = spark.createDataFrame([(1, "The DOG"), (2, "le chien"), (3, "und die")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(rows, model).collect()} == {1: "en", 2: "fr", 3: "de"}


def test_unseen_words_fall_back_to_shorter_grams(model):
    assert "hunde" not in model.words.index
    names = {i: g for g, i in model.grams.index.items()}
    rows = model.grams_known("hunde")
    assert [names[i] for i in rows] == ["<hund"] and model.langs[model.grams.total(rows, np.ones(1), 3).argmin()] == "de"
    assert {names[i] for i in model.grams_known("東京")} <= {"<", ">"}


def plain_costs(rows, text, max_n=5):
    """Mean cost of a text in each language from whole counts, by dictionaries and loops."""
    langs = sorted({x for _, x in rows})
    words = {x: Counter(w for t, y in rows if y == x for w in langid.words_of(t)) for x in langs}
    grams = {(x, n): Counter(g for w, k in words[x].items() for g in langid.grams_of(w, n) for _ in range(k)) for x in langs for n in range(1, max_n + 1)}
    cost = lambda tables, key: [-math.log(t[key] / t.total()) if t[key] else math.log(max(u.total() for u in tables)) + 1 for t in tables]
    found = []
    for w in langid.words_of(text):
        if any(w in words[x] for x in langs):
            found.append(cost([words[x] for x in langs], w))
            continue
        for n in range(max_n, 0, -1):
            own = [g for g in langid.grams_of(w, n) if any(g in grams[x, n] for x in langs)]
            if own:
                found.append([sum(c) / len(own) for c in zip(*(cost([grams[x, n] for x in langs], g) for g in own))])
                break
    return dict(zip(langs, [sum(c) / len(found) for c in zip(*found)]))


def test_scores_against_plain_code(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null")
    rows = docs.orderBy("doc_id").select("text", "lang").collect()
    model = langid.fit(docs, max_words=10**6, max_grams=10**6)
    texts = ["und sie", "elle quxzwv dans", "the then erthing yyy", "zzqx", rows[3][0][:2000]]
    got, scores = langid.score_texts(model, texts, {})
    for text, lang, score in zip(texts, got, scores):
        mean = plain_costs([(r[0] or "", r[1]) for r in rows], text)
        n = len(langid.words_of(text))
        p = {x: math.exp(-(c - min(mean.values())) * min(n, 8)) for x, c in mean.items()}
        assert lang == min(mean, key=mean.get) and score == pytest.approx(p[lang] / sum(p.values()))


def test_a_small_language_keeps_its_words(spark):
    rows = [(i, " ".join(f"large{'abcdefghij'[i % 10]}{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]}" for k in range(100)), "xx") for i in range(30)] + [(99, "tiny words only", "yy")]
    model = langid.fit(spark.createDataFrame(rows, DOCS), max_words=50, max_grams=50)
    assert {"tiny", "words", "only"} <= set(model.words.index) and len(model.words.index) <= 53
    assert langid.score_texts(model, ["tiny words"], {})[0] == ["yy"]


def test_edge_cases(spark, model):
    long = "the cat and " * 100_000
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? ²"), (4, "東京"), (5, long), (6, long), (None, "the cat")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = langid.predict(rows, model)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0)
    assert out[4][0] in model.langs and 0 <= out[4][1] <= 1
    assert out[5] == out[6] and out[5][0] == out[None][0] == "en"


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], DOCS)
    assert langid.fit(empty) is None
    assert langid.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), None).first()["lang_pred"] == "und"
    assert langid.predict(empty, None).count() == 0


def test_rejected_rows_go_and_columns_stay(spark, model):
    rows = spark.createDataFrame([(1, "the cat", "en"), (2, "...", "en"), (3, None, None)], DOCS)
    kept = langid.keep_identified(rows, model)
    assert kept.columns == rows.columns and [r["doc_id"] for r in kept.collect()] == [1]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = langid.held_out(F.col("doc_id"))
    got = langid.predict(docs, langid.fit(docs.where(~held))).join(docs.select("doc_id", "lang"), "doc_id").where(held)
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right / n > 0.98
