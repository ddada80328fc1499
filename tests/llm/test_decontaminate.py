"""Decontamination: alignment against a plain table of scores, planted copies, edge cases."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adlayer.llm import decontaminate as d


def plain(item, part):
    table = np.zeros((len(item) + 1, len(part) + 1), int)
    for i, x in enumerate(item, 1):
        for j, y in enumerate(part, 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (d.MATCH if x == y else d.MISMATCH), table[i - 1, j] + d.GAP, table[i, j - 1] + d.GAP)
    return int(table.max())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=25))
def test_alignment_score(item, part):
    assert d.align(np.array(item, int), np.array(part, int))[0] == plain(item, part)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
EDITED = "alpha beta gamma delta epsilon other zeta eta theta iota lambda mu"
NOISE = "lorem ipsum dolor sit amet consectetur adipiscing elit"


def test_planted_copies(spark):
    rows = [(1, f"{NOISE} {ITEM.upper()}. {NOISE}"), (2, f"{NOISE} {EDITED}"), (3, NOISE), (4, f"{NOISE} alpha beta gamma delta {NOISE}"), (5, None), (6, ""), (7, f"{NOISE} tiny thing"), (8, "Tiny thing!"), (1, ITEM), (None, ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, ""), (13, "tiny thing"), (14, ITEM)], "item_id long, text string")
    got = {}
    for r in d.contaminated(docs, items).collect():
        got.setdefault((r["doc_id"], r["item_id"]), []).append(r)
    assert set(got) == {(1, 10), (1, 14), (2, 10), (2, 14), (8, 13), (None, 10), (None, 14)}
    assert len(got[1, 10]) == 2 and max(r["similarity"] for r in got[1, 10]) == 1.0
    assert 0.6 <= got[2, 10][0]["similarity"] < 1.0
    first = min(got[1, 10], key=lambda r: -r["first_word"])
    assert (first["first_word"], first["end_word"]) == (8, 20)
    blocks = {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, items, block_words=10).collect()}
    assert blocks == set(got)
    clashing = docs.withColumn("item", F.lit("clash")).withColumn("text_key", F.lit(1))
    kept = d.drop_contaminated(clashing, items)
    assert kept.columns == clashing.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 4, 5, 6, 7]


def test_common_passages_are_found(spark):
    docs = spark.createDataFrame([(i, f"{NOISE} {i} {ITEM} {i}") for i in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert d.contaminated(docs, items, rare_docs=5).count() == 300


def test_edited_copies_of_a_common_item_are_found(spark):
    item = [f"w{i}" for i in range(39)]
    edited = lambda *at: " ".join(f"other{i}" if i in at else w for i, w in enumerate(item))
    half = edited(5, 12, 19, 26, 33)  # 20 of 36 seeds broken
    one = edited(3, 7, 11, 15, 19, 23, 27, 31, 36)  # a single seed intact, score (30 * 2 - 9) / 78
    passing = " ".join(item[32:35]) + " " + NOISE  # the same seed, nothing else
    rows = [(i, f"{NOISE} {i} {' '.join(item)} {i}") for i in range(300)] + [(300, f"{NOISE} {half} {NOISE}"), (301, f"{NOISE} {one} {NOISE}"), (302, passing)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in d.contaminated(docs, items).collect()} == set(range(302))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=12), st.lists(st.sampled_from("abcd"), max_size=25), st.lists(st.tuples(st.integers(0, 20), st.integers(0, 8)), max_size=3))
def test_no_alignment_exceeds_what_is_reachable(item, text, hits):
    assert d.similarity(item, text, hits)[0] <= d.reachable(item, text, hits)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert d.contaminated(docs, items).count() == 0 and d.contaminated(some, items).count() == 0 and d.drop_contaminated(some, items).count() == 1


def test_recall_by_edit_rate(spark):
    """All copies that reach the least score by the plain table of scores are found, at any rate and kind of edits."""
    draw, rows, want, item = random.Random(3), [], set(), [f"w{i}" for i in range(40)]
    for k in range(300):
        words, rate, kind = [], draw.choice((0.05, 0.1, 0.2, 0.25, 0.3)), k % 4
        for w in item:
            edit = draw.random() < rate
            if edit and kind in (0, 3):
                words.append(f"x{draw.randrange(99)}")
            elif edit and kind == 1:
                continue
            elif edit:
                words += [f"x{draw.randrange(99)}", w]
            else:
                words.append(w)
        words = NOISE.split() + words + NOISE.split()
        rows.append((k, " ".join(words)))
        own = {w: i for i, w in enumerate(item)}
        if plain(list(range(40)), [own.get(w, -1) for w in words]) >= 0.6 * 80:
            want.add(k)
    every_fourth = " ".join("changed" if i % 4 == 3 else w for i, w in enumerate(item))
    in_pairs = " ".join(f"{w} put" if i % 2 else w for i, w in enumerate(item))
    rows += [(300, every_fourth), (301, in_pairs)]
    found = d.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r["doc_id"] for r in found.collect()} == want | {300, 301} and 150 < len(want) < 300


def test_long_texts_and_common_items(spark):
    docs = spark.createDataFrame([(1, "the cat " * 200_000 + ITEM), (2, "the " * 100)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "the"), (3, "the cat")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["first_word"]) for r in d.contaminated(docs, items).collect()] == [(1, 1, 400_000)]
