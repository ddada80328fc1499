"""SimHash: fingerprints, the pigeonhole scheme, links and classes, against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from adlayer.llm import simhash
from adlayer.llm.common import split_join

DATA = "/root/testdata/sf0.01"


def fingerprint(text: str | None, width: int = 3) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, radius):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(zip(ids, prints), 2):
        if (a ^ b).bit_count() <= radius:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB Ä\t\n z", max_size=60))
def test_fingerprint_is_the_bitwise_majority(text):
    assert int.from_bytes(simhash.fingerprint_bytes(text.encode()), "big") == fingerprint(text)


@pytest.mark.parametrize("radius", [1, 3, 6])
def test_every_pair_within_the_radius_shares_a_signature(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(-(2**63), 2**63, 60, dtype=np.int64)
    near = [int(b) ^ int(sum(1 << int(x) for x in rng.choice(63, radius, replace=False))) for b in base]
    fps = np.array([*base.tolist(), *near], dtype=np.int64)
    for m in range(2, 7):
        scheme = simhash.plan(fps, 10**m, radius, range(m, m + 1))
        assert sum(scheme.thresholds) == radius - m + 1 and sorted(b for p in scheme.parts for b in p) == list(range(64))
        for a, b in itertools.combinations(fps.tolist(), 2):
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                assert any(((a ^ b) & sum(1 << x for x in p)).bit_count() <= t for p, t in zip(scheme.parts, scheme.thresholds))


def test_thresholds_are_allocated_at_least_cost():
    costs = [{-1: 0.0, 0: 9.0, 1: 10.0}, {-1: 0.0, 0: 1.0, 1: 50.0}]
    best = min((costs[0][a] + costs[1][b], (a, b)) for a in costs[0] for b in costs[1] if a + b == 0)
    assert simhash.allocate(costs, 0) == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 2), st.integers(0, 255)), max_size=150), st.integers(0, 2), st.integers(0, 3))
def test_groups_link_as_all_pairs_do(rows, threshold, radius):
    rows = [r for r in rows if r[1] <= threshold]
    low, flips, fps = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
    a, b = simhash.link_group(low, flips, fps, np.zeros((len(rows), 0), np.uint64), 4, threshold, radius, 128)
    want, found = simhash._Classes(len(rows)), simhash._Classes(len(rows))
    for i, j in itertools.combinations(range(len(rows)), 2):
        near = int(low[i] ^ low[j]).bit_count() + max(flips[i], flips[j]) <= threshold
        if 0 in (flips[i], flips[j]) and near and int(fps[i] ^ fps[j]).bit_count() <= radius:
            want.join(np.array([i]), np.array([j]))
    found.join(np.array(a, dtype=int), np.array(b, dtype=int))
    assert found.root.tolist() == want.root.tolist()


@pytest.mark.parametrize(("radius", "both"), [(3, None), (9, 24)])
def test_links_of_clusters_against_all_pairs(spark, radius, both):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, (12, 2), dtype=np.int64)
    rows = set()
    for x, y in base.tolist():
        for _ in range(40):
            flip = [int(sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), replace=False))) for _ in range(2)]
            rows.add((x ^ flip[0], y ^ flip[1] if both else 0))
    rows = sorted(rows)
    limit = both or 128
    for block in (262_144, 16):
        word = lambda x: (x & (2**64 - 1)).to_bytes(8, "little") if both else b""
        got = simhash.links(spark.createDataFrame([(x, word(y)) for x, y in rows], "fp long, more binary"), radius, limit, block)
        at = {(x, word(y)): i for i, (x, y) in enumerate(rows)}
        found, want = simhash._Classes(len(rows)), simhash._Classes(len(rows))
        for r in got.collect():
            found.join(np.array([at[r["a"], bytes(r["a_more"])]]), np.array([at[r["b"], bytes(r["b_more"])]]))
        for (i, p), (j, q) in itertools.combinations(enumerate(rows), 2):
            d = [((p[k] ^ q[k]) & (2**64 - 1)).bit_count() for k in range(2)]
            if d[0] <= radius and sum(d) <= limit:
                want.join(np.array([i]), np.array([j]))
        assert found.root.tolist() == want.root.tolist() and len(set(want.root.tolist())) > 1


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 400")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, block=8).collect()}  # blocks so small that common values are divided
    prints = {i: fingerprint(t) for i, t in rows.items()}
    assert {i: got[i]["fingerprint"] for i in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: got[i]["component_id"] for i in rows} == components(sorted(rows), [prints[i] for i in sorted(rows)], 3)


def test_edge_cases(spark):
    long = "word salad with dressing " * 20_000
    rows = [(7, None), (3, ""), (9, " \n"), (5, long), (4, long), (4, long), (None, "one two"), (1, "one two")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got}
    assert by[7] == by[3] == by[9] == ("0" * 16, 3)
    assert by[5] == by[4] and by[5][1] == 4 and by[None][1] == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_classes_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.classes(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_classes_that_are_stars_take_no_step(spark, monkeypatch):
    staged, stage = [], simhash.stage
    monkeypatch.setattr(simhash, "stage", lambda df, name: staged.append(name) or stage(df, name))
    stars = [(1, i) for i in range(2, 9)] + [(i, 10) for i in range(11, 14)] + [(11, 10), (20, 20)]
    got = {r["node"]: r["root"] for r in simhash.classes(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 9)}, **{i: 10 for i in range(11, 14)}}
    assert staged == ["edges", "least"]


@pytest.mark.parametrize("edges_of_a_task", [1 << 16, 64])
def test_forests_leave_few_steps(spark, monkeypatch, edges_of_a_task):
    staged, stage = [], simhash.stage
    monkeypatch.setattr(simhash, "stage", lambda df, name: staged.append(name) or stage(df, name))
    monkeypatch.setattr(simhash, "_EDGES", edges_of_a_task)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {x: new if r == old else r for x, r in root.items()}
    got = {r["node"]: r["root"] for r in simhash.classes(spark.createDataFrame(edges, "a long, b long").repartition(16)).collect()}
    assert got == {x: r for x, r in root.items() if x != r}
    assert staged.count("large") <= (0 if edges_of_a_task > 64 else 2)


def test_a_forest_keeps_what_its_edges_join():
    batches = [pa.RecordBatch.from_pydict({"a": [9, 5, 7], "b": [5, 3, 8]}), pa.RecordBatch.from_pydict({"a": [8, 1, 3], "b": [7, 2, 9]})]
    found = [(x["a"], x["b"]) for batch in simhash._forest(iter(batches)) for x in batch.to_pylist()]
    assert sorted(found) == [(1, 2), (3, 5), (3, 9), (7, 8)]
    assert list(simhash._forest(iter([]))) == []


def test_only_keys_of_many_rows_are_split_off(spark):
    rows = spark.createDataFrame([(1 if i < 600 else i, i) for i in range(1000)], "k long, i long")
    labels = rows.groupBy("k").count().withColumnRenamed("count", "n")
    few = split_join(rows.where("i >= 600"), labels.where("k <> 1"), ["k"], 400)
    many = split_join(rows, labels, ["k"], 1000)
    assert [x._jdf.queryExecution().analyzed().toString().count("Union") for x in (few, many)] == [0, 1]
    assert {(r["i"], r["n"]) for r in few.collect()} == {(i, 1) for i in range(600, 1000)} and few.count() == 400
    assert {(r["i"], r["n"]) for r in many.collect()} == {(i, 600 if i < 600 else 1) for i in range(1000)} and many.count() == 1000


def test_one_of_each_group_stays(spark):
    words = [f"w{i}" for i in range(300)]
    near = words.copy()
    near[150] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words)), (4, " ".join(f"v{i}" for i in range(300))), (4, " ".join(f"v{i}" for i in range(300)))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_the_pipeline_takes_its_groups_from_the_pigeonhole_join(spark, monkeypatch):
    import corpus_pipeline

    rng, base = random.Random(3), [[f"w{i}x{k}" for i in range(200)] for k in range(6)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for edits in (1, 2, 3, 4, 60):
            own = b.copy()
            for i in rng.sample(range(200), edits):
                own[i] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    called, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: called.append(a[1:]) or links(*a, **k))
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()}
    assert called == [(simhash.RADIUS, simhash.BOTH)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root = [root[i] if r == root[j] else r for r in root]
    assert got == set(root) and len(got) < len(texts)
