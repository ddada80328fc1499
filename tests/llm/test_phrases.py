"""Phrase mining against plain counting, whatever the filters let through, and odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from adlayer.llm import phrases as p


def plain(rows, least, top, longest=5):
    f, n, pieces = Counter(), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        pieces += [(lang, [w for w in re.split("[ \t]+", x) if w]) for x in re.split("[.,;:!?\n\x0b\x0c\r]", low)]
    for lang, words in pieces:
        n[lang] += len(words)
        f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        if any(b >= a and l == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) for (l, v), b in often(f, least)):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, w.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for i, (s, a, w, l, r) in enumerate(sorted(own)[:top]))


def often(f, least):
    return [(key, c) for key, c in f.items() if c >= least and len(key[1]) > 2]


def made(seed=1, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Été", "È"]
    fixed = ["new york city", "a A a a", "w1 w2 w3 w4 w5 w6", "rio de janeiro"]
    rows = []
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(25))]
        rows.append((rng.choice([" ", "  ", "\t"]).join(parts).replace("w9", rng.choice([",", "w9.", "\n", "w9\r"])), rng.choice(["en", "fr", None])))
    return rows


@pytest.mark.parametrize("buckets", [8, 1 << 10, 1 << 18])
def test_plain(spark, buckets):
    """Eight buckets let everything through."""
    rows = made()
    got = p.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(5), min_count=20, top=40, buckets=buckets)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, 20, 40)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 30


def test_filters_prune(spark):
    """A phrase of rare parts, or of a rare bucket, isn't counted."""
    rows = made(2) + [(f"q{i} z{i} q{i}", "en") for i in range(500)]
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    own = df.selectExpr("coalesce(lang, 'und') as lang", "text")
    raw = own.mapInArrow(p._first(20, 1 << 18, True), p._RAW).cache()
    words = raw.where("phrase is not null").groupBy("lang", "phrase").sum("n").toDF("lang", "phrase", "f").where("f >= 20")
    seen, parts = p.bitmap(raw, 20, 1 << 18), p.bitmap(words.mapInArrow(p._marked(1 << 18), p._RAW), 1, 1 << 18)
    counted = raw.where("ids is not null").mapInArrow(p._pass(2, 20, 1 << 18, False, parts, seen, parts), p._RAW).collect()
    assert counted and not [r for r in counted if "q1" in r["phrase"].split() or r["n"] < 5]


def test_odd_rows(spark):
    rows = [(None, "en", 1), ("", "en", 2), ("..!?\n", None, 3), ("x " * 30_000, "en", 4), ("x\x00y x\x00y " * 60, None, 5), ("one two", "und", 6)]
    df = spark.createDataFrame(rows, "text string, lang string, score int")
    got = {r["phrase"]: r for r in p.collocations(df, min_count=50).collect()}
    assert (got["x x"]["a"], got["x x"]["l"], got["x x"]["n"], got["x x"]["lang"]) == (29_999, 30_000, 30_000, "en")
    assert got["x\x00y x\x00y"]["a"] == 119 and got["x\x00y x\x00y"]["n"] == 122
    assert p.collocations(df.where("false")).count() == 0 and p.collocations(df.where("score < 4")).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        p.frequent(df, buckets=100)


def test_few_tasks_give_counts(spark, monkeypatch):
    """A phrase is given out once a task, by two tasks a core at most, however many parts the texts are in; the session stays as it was."""
    rows, most, batches, real = made(), [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), p.stage

    def stage(df, name, **rest):
        out = real(df, name, **rest)
        if re.fullmatch("pass[2-5]", name):
            most.append(out.where("phrase is not null").groupBy("lang", "phrase").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(p, "stage", stage)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = p.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(20), min_count=20, top=40)
        assert sorted(map(tuple, got.collect())) == plain(rows, 20, 40)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert 0 < max(most) <= 2 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batches
