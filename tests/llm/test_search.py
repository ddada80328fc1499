"""BM25 search against scoring every document."""

from __future__ import annotations

import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from adlayer.llm import search

DATA = "/root/testdata/sf0.01"


def brute(docs, queries, k=10, k1=1.2, b=0.75):
    counts = [(i, Counter(search.words_of(t))) for i, t in docs]
    n, mean = len(docs), sum(sum(c.values()) for _, c in counts) / max(len(docs), 1)
    df = Counter(w for _, c in counts for w in c)
    idf = {w: math.log(1 + (n - m + 0.5) / (m + 0.5)) for w, m in df.items()}
    out = {}
    for q, text in queries:
        rows = []
        for i, c in counts:
            norm = k1 * (1 - b + b * sum(c.values()) / mean)
            score = sum(m * idf[w] * c[w] * (k1 + 1) / (c[w] + norm) for w, m in Counter(search.words_of(text)).items() if w in c)
            if score > 0 and i is not None:
                rows.append((round(score, 6), i))
        out[q] = sorted(rows, key=lambda r: (-r[0], r[1]))[:k]
    return {q: rows for q, rows in out.items() if rows}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((round(r["score"], 6), r["doc_id"]))
    return out


@pytest.mark.parametrize("options", [{}, {"shard_docs": 40, "block_docs": 4}, {"max_terms": 300}])
def test_documents_against_all(spark, options):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 300").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    queries = docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    got = found(search.search(docs, queries, **options))
    assert got == brute(rows, [r for r in rows if r[0] % 50 == 0])


def test_edge_cases(spark):
    rows = [(1, "red fox red"), (2, "red fox red"), (2, "red fox red"), (3, None), (4, ""), (5, "fox " * 50_000), (None, "red fox"), (6, "!?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = [(1, "RED fox"), (2, None), (3, ""), (4, "unknown words"), (5, "fox")]
    queries = spark.createDataFrame([*asked, (1, "RED fox"), (None, "red")], "query_id long, text string")
    assert found(search.search(docs, queries)) == brute(rows, asked)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert search.search(empty, queries).count() == 0
    assert search.search(docs, spark.createDataFrame([], "query_id long, text string")).count() == 0


def test_postings_are_left_unread():
    """Counted as read: far fewer than the query's lists hold; the k best are those of scoring every document."""
    rng = np.random.default_rng(1)
    topic = np.repeat(np.arange(40), 500)  # documents of one topic stand together
    terms = [np.unique(np.r_[rng.zipf(1.3, 30) % 400, 400 + 15 * t + rng.integers(0, 15, 6)]).astype(np.int32) for t in topic]
    sizes = np.array(list(map(len, terms)))
    df = np.bincount(np.concatenate(terms), minlength=1000)
    idf = np.log(1 + (len(terms) - df + 0.5) / (df + 0.5))
    every = np.concatenate(terms)
    shard = search.Shard(np.arange(len(terms)), sizes, sizes, every, np.ones(len(every), int), idf, sizes.mean(), 1.2, 0.75, 64)
    shares = []
    for q in range(0, 20_000, 997):
        query = np.r_[terms[q][:6], terms[q][-4:]]  # frequent words and words of the topic
        dense, best, weights = np.zeros(1000), search.Best(10), np.ones(len(query))
        read = search.evaluate(shard, query, weights, best, dense)
        assert not dense.any()
        dense[query] = 1
        scores = shard.full(np.arange(len(terms)), dense)
        want = np.lexsort((np.arange(len(terms)), -scores))[:10]
        assert best.ids.tolist() == want.tolist() and best.scores.tolist() == scores[want].tolist()
        shares.append(read / df[query].sum())
        again = search.evaluate(shard, query, weights, search.Best(10), np.zeros(1000))
        assert again == read
    assert np.mean(shares) < 0.25 and max(shares) < 0.6


def test_words_of_all_documents_still_match():
    """A word that every document has scores next to nothing, but not nothing."""
    n = 10**4
    idf = np.array([math.log(1 + 0.5 / (10**12 + 0.5))])
    shard = search.Shard(np.arange(n), np.ones(n, int), np.ones(n, int), np.zeros(n, np.int32), np.ones(n, int), idf, 1.0, 1.2, 0.75, 64)
    best = search.Best(10)
    search.evaluate(shard, np.array([0]), np.ones(1), best, np.zeros(1))
    assert best.ids.tolist() == list(range(10)) and (best.scores > 0).all()


def test_long_lists_are_summed_at_once():
    """Whole documents as queries: the sums of long lists hold, few postings are left to read, and the k best are those of scoring every document."""
    rng = np.random.default_rng(2)
    terms = [np.unique(np.r_[rng.zipf(1.2, 120) % 3000, rng.integers(0, 3000, 20)]).astype(np.int32) for _ in range(3001)]
    sizes = np.array(list(map(len, terms)))
    every = np.concatenate(terms)
    idf = np.log(1 + (len(terms) - (df := np.bincount(every, minlength=3000)) + 0.5) / (df + 0.5))
    shard = search.Shard(np.arange(len(terms)), sizes, sizes, every, rng.integers(1, 5, len(every)), idf, sizes.mean(), 1.2, 0.75, 64)
    asked = [(q, terms[q], rng.integers(1, 9, sizes[q]).astype(float)) for q in range(0, 3001, 100)] + [(-1, terms[7][:2], np.ones(2)), (-2, terms[7][:0], np.ones(0))]
    read = plain = 0
    for (q, own, weights), sums in zip(asked, shard.long_sums(asked)):
        dense, best = np.zeros(3000), search.Best(10)
        dense[own[shard.long_at[own] >= 0]] = weights[shard.long_at[own] >= 0]
        exact = shard.full(np.arange(len(terms)), dense)
        assert (exact <= sums).all() and (sums <= exact * (1 + search.ROUNDED)).all()
        dense[:] = 0
        read += search.evaluate(shard, own, weights, best, dense, sums)
        plain += search.evaluate(shard, own, weights, search.Best(10), dense)
        assert not dense.any()
        dense[own] = weights
        scores = shard.full(np.arange(len(terms)), dense)
        want = np.lexsort((np.arange(len(terms)), -scores))[:10]
        assert best.ids.tolist() == want[scores[want] > 0].tolist() and best.scores.tolist() == scores[want[scores[want] > 0]].tolist()
    assert 4 * read < plain


@pytest.mark.parametrize("options", [{"pass_terms": 300}, {"max_terms": 700, "pass_terms": 200, "shard_docs": 60, "block_docs": 4}])
def test_queries_in_some_passes(spark, options):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 300").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    queries = docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    assert found(search.search(docs, queries, **options)) == brute(rows, [r for r in rows if r[0] % 50 == 0])


def test_texts_are_read_once_for_queries_of_the_same_words(spark, monkeypatch):
    """The words of all queries together fit a task, however many queries have them."""
    staged, stage = [], search.stage
    monkeypatch.setattr(search, "stage", lambda df, name: staged.append(name) or stage(df, name))
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{w}" for w in rng.integers(0, 23, 19 + i))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(search.search(docs, docs.withColumnRenamed("doc_id", "query_id"), max_terms=30)) == brute(rows, rows)
    assert staged.count("index") == 1


def test_alike_documents_share_a_shard():
    """Documents of two languages, which share some words, mixed: each goes to its own; the k best are those of scoring every document, over two parts."""
    rng = np.random.default_rng(3)
    n, vocabulary = 3000, 6000
    language = rng.integers(0, 2, n)
    drawn = [np.r_[[l] * 9, 2 + (rng.zipf(1.2, 80) % 2900) * 2 + l, rng.integers(5900, vocabulary, 2)] if i % 500 else [] for i, l in enumerate(language)]
    lists = [np.unique(np.array(x, np.int32), return_counts=True) for x in drawn]
    size, terms, counts = np.array([len(t) for t, _ in lists]), np.concatenate([t for t, _ in lists]), np.concatenate([c for _, c in lists])
    start, length = np.cumsum(size) - size, np.array(list(map(len, drawn)))
    idf = np.log(1 + (n - (df := np.bincount(terms, minlength=vocabulary)) + 0.5) / (df + 0.5))
    parts, whole = [], search.Shard(np.arange(n), length, size, terms, counts, idf, length.mean(), 1.2, 0.75, 64)
    for i, j in ((0, 2000), (2000, n)):
        to = start[j] if j < n else len(terms)
        groups = search.alike(size[i:j], terms[start[i] : to], counts[start[i] : to])
        assert sorted(np.concatenate(groups).tolist()) == list(range(j - i)) and all((np.diff(g) > 0).all() for g in groups)
        assert sorted(len(set(language[g[size[g + i] > 0] + i])) for g in groups)[-2:] == [1, 1]
        at = [search._spans(start[g + i], size[g + i]) for g in groups]
        parts.append([search.Shard(g + i, length[g + i], size[g + i], terms[a], counts[a], idf, length.mean(), 1.2, 0.75, 64) for g, a in zip(groups, at)])
    asked = [(q, *lists[q]) for q in range(0, n, 30) if size[q]] + [(-1, np.array([2, 4, 5901], np.int32), np.ones(3))]
    best, dense = [search.Best(10) for _ in asked], np.zeros(vocabulary)
    for shards in parts:
        search.answer(shards, asked, best, dense)
        assert not dense.any()
    for (_, own, weights), got in zip(asked, best):
        dense[own] = weights
        scores = whole.full(np.arange(n), dense)
        dense[own] = 0
        want = np.lexsort((np.arange(n), -scores))[:10]
        want = want[scores[want] > 0]
        assert got.ids.tolist() == want.tolist() and got.scores.tolist() == scores[want].tolist()
    few, own = search.Best(10), [(0, np.array([0], np.int32), np.ones(1))]
    assert search.answer(parts[0], own, [few], dense) == 0 and set(language[few.ids]) == {0}  # a long list: by its sums


@pytest.mark.parametrize("words", [1, 4, 1 << 18])
def test_words_are_numbered_some_texts_at_a_time(monkeypatch, words):
    monkeypatch.setattr(search, "_WORDS", words)
    texts = ["b a b", None, "", "x y", "c x a a a", "b"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "text": ["a", "b", "c", *texts]}).slice(3)
    made = list(search._index(SimpleNamespace(value={"a": 0, "b": 1, "c": 2}))(iter([batch, batch.slice(0, 0)])))
    rows = [tuple(r.values()) for b in made for r in b.to_pylist()]
    assert rows == [(3, 3, [0, 1], [1, 2]), (4, 0, [], []), (5, 0, [], []), (6, 2, [], []), (7, 5, [0, 2], [3, 1]), (8, 1, [1], [1])]
    assert len(made) == {1: 4, 4: 3, 1 << 18: 1}[words]
