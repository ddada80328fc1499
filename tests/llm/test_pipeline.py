"""The pipeline: stages in order, their columns, and planted cases through each."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
from adlayer.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_queries_are_complete():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES] == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    before = docs
    for i, (name, apply) in enumerate(corpus_pipeline.STAGES):
        after = apply(spark, before, SF).cache()
        ids = {r["doc_id"] for r in after.collect()}
        assert ids <= {r["doc_id"] for r in before.collect()} and ids, name
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == names and after.count() == len(ids)
        before = after
    assert before.columns == [*names, "copy"]


ITEM = [f"item{i}" for i in range(20)]
MAIL = "ann.lee42@mail8.example.com"


def fixture(spark):
    """Rows (doc_id, text, lang, source): planted cases of all stages, null ids, repeated rows, ties."""
    draw = random.Random(8)
    common = "the of and to in is that for it was".split()
    own = lambda n: " ".join(f"w{draw.randrange(10**6)} {draw.choice(common)}" for _ in range(n // 2))
    base = own(120)
    near = base.split()
    near[60] = "changed"
    half = base.split()[:60] + own(60).split()
    edited = ["other" if i in (5, 12) else w for i, w in enumerate(ITEM)]
    texts = [base, base, " ".join(near), " ".join(half), own(40) + " " + " ".join(ITEM), own(40) + " " + " ".join(edited) + " " + own(10), f"{own(50)} {MAIL} {own(20)}", "!!! 123", None, "", own(60), own(61)]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, own(50), "en", None, 1), (None, base, "en", "s0", 1), rows[10], (50, f"{own(30)} {MAIL.upper()}", None, "s1", 1)]
    return spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def score(item, words):
    """Smith-Waterman by the whole table."""
    best, last = 0, [0] * (len(words) + 1)
    for x in item:
        row = [0]
        for j, y in enumerate(words, 1):
            row.append(max(0, last[j - 1] + (2 if x == y else -1), last[j] - 1, row[j - 1] - 1))
        best, last = max(best, *row), row
    return best


def test_each_stage_against_plain_code(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(ITEM)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = lambda r: (str(r["doc_id"]), r["text"] or "")
    rows, docs = sorted(fixture(spark).collect(), key=key), fixture(spark)
    for name, apply in corpus_pipeline.STAGES:
        after = apply(spark, docs, str(tmp_path)).cache()
        got = sorted(after.collect(), key=key)
        if name == "language_id":
            want = [r for r in rows if re.search(r"[^\W\d_]", r["text"] or "")]
        elif name == "near_dedup":
            order = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
            root = list(range(len(order)))
            for i, a in enumerate(order):
                for j in range(i):
                    x, y = shingles(a["text"]), shingles(order[j]["text"])
                    if 5 * len(x & y) >= 4 * len(x | y):
                        root = [root[j] if k == root[i] else k for k in root]
            want = sorted((order[i] for i in {root.index(k) for k in root}), key=key)
        elif name == "decontaminate":
            want = [r for r in rows if score(ITEM, r["text"].lower().split()) < 0.6 * 2 * len(ITEM)]
        elif name == "pii":
            assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows] and not any("mail8" in r["text"].lower() for r in got)
            for a, b in zip(rows, got):
                cut = re.split(MAIL, a["text"], flags=re.I)
                assert (b["text"] == a["text"]) == (len(cut) == 1) and all(p in b["text"] for p in cut) and b["n_chars"] == len(b["text"])
            mails = {m.lower() for r in got for m in re.findall(r"\S+@\S+", r["text"])}
            assert len(mails) == 1
            want = got
        else:
            sizes, taken = Counter(), Counter()
            for r in rows:
                sizes[r["source"]] += len(r["text"].split())
            for r in got:
                taken[r["source"]] += len(r["text"].split())
            names = sorted((s for s in sizes if s), key=str) + [s for s in sizes if s is None]
            weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
            target, free, left = {}, set(names), sum(sizes.values())
            while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]}:
                target |= {s: 3 * sizes[s] for s in over}
                free, left = free - over, left - sum(3 * sizes[s] for s in over)
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            largest = max(len(r["text"].split()) for r in rows)
            assert all(abs(taken[s] - target[s]) <= largest for s in names)
            copies = Counter((r["doc_id"], r["text"]) for r in got)
            assert max(copies.values()) <= 3 and {r["copy"] for r in got} <= {1, 2, 3}
            want = got
        assert list(map(tuple, got)) == list(map(tuple, want)), name
        assert after.columns[:5] == docs.columns
        rows, docs = got, after
    ids = {r["doc_id"] for r in rows}
    assert ids <= {0, 3, 6, 10, 11, 50, None}


def test_queries_run(spark):
    for name, q in QUERIES.items():
        if name in ("op4_warc_derivatives", "op6_mix_sources", "op8_decontaminate"):
            assert q(spark, SF).count() > 0
