"""Centroid clustering of vectors in exact integers, by filtering over ball trees.

Vectors are scaled and floored to integers, so sums, means and distances have
one value whatever the order. Each task builds trees over blocks of its
vectors, once; a tree's node has a ball (centre and radius), a count and the
sum of its vectors. A round takes each ball from the root down: a centroid
whose distance to the centre exceeds the nearest one's by more than the
diameter can own none of its vectors (triangle inequality), and where one
centroid is left the node's count and sum go to it whole. Otherwise the ball's
two halves are looked at, and at the leaves the vectors themselves, by exact
distances. So a round reads its trees, and passes on a count and a sum for
each centroid and task; the driver gets those of all tasks together.

Balls are compared in floating point with a margin beyond its error; what is
within the margin descends, so ties are settled at the leaves only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage

#: Vectors of a leaf and of a tree, at most.
LEAF, BLOCK = 32, 2048
#: Components may be this large, so that squared distances of some thousand components fit 64 bits.
LARGEST = 1 << 25
_MARGIN = 1e-9
_NODES = {"begin": np.int32, "end": np.int32, "child": np.int32, "radius": np.float64, "centre": np.float64, "sum": np.int64}


@dataclass
class Tree:
    """points in the order of the leaves; node i has points begin[i] to end[i] - 1, and the nodes child[i] and child[i] + 1, or -1."""

    points: np.ndarray
    order: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    radius: np.ndarray
    centre: np.ndarray
    sum: np.ndarray


def grow(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A ball tree over the rows of points (integers)."""
    order = np.arange(len(points))
    begin, end, child, radius, centre, total = [0], [len(points)], [], [], [], []
    at = 0
    while at < len(begin):
        own = points[order[begin[at] : end[at]]]
        middle = own.mean(axis=0)
        away = np.sqrt(((own - middle) ** 2).sum(axis=1))
        centre.append(middle)
        radius.append(away.max())
        total.append(own.sum(axis=0))
        if len(own) <= leaf or away.max() == 0:
            child.append(-1)
        else:
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            half = len(own) // 2
            part = np.argpartition(own.astype(np.float64) @ (other - one).astype(np.float64), half)
            order[begin[at] : end[at]] = order[begin[at] : end[at]][part]
            child.append(len(begin))
            begin += [begin[at], begin[at] + half]
            end += [begin[at] + half, end[at]]
        at += 1
    return Tree(points[order], order, np.array(begin), np.array(end), np.array(child), np.array(radius), np.array(centre), np.array(total))


def _squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column for each centroid."""
    out = np.empty((len(points), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        out[:, k] = ((points - c) ** 2).sum(axis=1)
    return out


def assign(tree: Tree, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Whole balls as (nodes, clusters) of each level, then the points that leaves decided, and their clusters; ties to the smaller number."""
    whole, rows, nodes = [], [], np.zeros(1, np.int64)
    able = np.ones((1, len(centroids)), bool)
    near = centroids.astype(np.float64)
    while len(nodes):
        apart = np.sqrt(((tree.centre[nodes][:, None] - near) ** 2).sum(axis=2))
        least = np.where(able, apart, np.inf).min(axis=1)
        reach = least + 2 * tree.radius[nodes]
        able &= apart <= (reach + _MARGIN * (1 + reach))[:, None]
        alone = able.sum(axis=1) == 1
        whole.append((nodes[alone], able[alone].argmax(axis=1)))
        nodes, able = nodes[~alone], able[~alone]
        ends = tree.child[nodes] < 0
        rows += [np.arange(tree.begin[i], tree.end[i]) for i in nodes[ends].tolist()]
        nodes, able = nodes[~ends], able[~ends]
        nodes = np.concatenate([tree.child[nodes], tree.child[nodes] + 1])
        able = np.concatenate([able, able])
    found = np.concatenate([np.zeros(0, np.int64), *rows])
    return whole, found, _squared(tree.points[found], centroids).argmin(axis=1)


def integers(vectors: DataFrame, width: int, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<int>): floor(scale * x) of each component, for vectors of `width` components that are all finite numbers.

    A finite component beyond LARGEST after scaling is an error, as 64 bits wouldn't hold its distances.
    """
    own = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x: Column) -> Column:
        y = F.lit(float(scale)) * x
        return F.when(F.abs(y) <= LARGEST, F.floor(y)).otherwise(F.raise_error(F.concat(F.lit("component beyond the range of exact distances: "), x.cast("string"))).cast("long")).cast("int")

    return own.where((F.size("e") == width) & finite).select("vec_id", F.transform("e", whole).alias("v"))


def _trees(width: int):
    """(ids, points, kind, nodes...): a tree a row."""

    def done(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        tree = grow(points)
        kind = next(t for t in ("i1", "i2", "i4") if np.abs(points).max(initial=0) <= np.iinfo(t).max)
        columns = [pa.array([ids.take(pa.array(tree.order)).to_pylist()], pa.list_(ids.type)), pa.array([tree.points.astype(kind).tobytes()]), pa.array([kind])]
        columns += [pa.array([getattr(tree, n).astype(t).tobytes()]) for n, t in _NODES.items()]
        return pa.RecordBatch.from_arrays(columns, ["ids", "points", "kind", *_NODES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                ids.append(some.column("vec_id"))
                parts.append(some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64))
                held += some.num_rows
                while held >= BLOCK:
                    names, points = pa.concat_arrays(ids), np.concatenate(parts)
                    yield done(names.slice(0, BLOCK), points[:BLOCK])
                    ids, parts, held = [names.slice(BLOCK)], [points[BLOCK:]], held - BLOCK
        if held:
            yield done(pa.concat_arrays(ids), np.concatenate(parts))

    return run


def _tree_of(batch: pa.RecordBatch, i: int, width: int) -> Tree:
    node = {n: np.frombuffer(batch.column(n)[i].as_py(), t) for n, t in _NODES.items()}
    node |= {n: node[n].reshape(-1, width) for n in ("centre", "sum")}
    points = np.frombuffer(batch.column("points")[i].as_py(), batch.column("kind")[i].as_py()).reshape(-1, width).astype(np.int64)
    return Tree(points, np.arange(len(points)), **node)


def _round(centroids: np.ndarray):
    """(cluster, n, total): of each task, the vectors of each cluster and their sum."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                tree = _tree_of(batch, i, width)
                whole, rows, to = assign(tree, centroids)
                for nodes, clusters in whole:
                    np.add.at(n, clusters, tree.end[nodes] - tree.begin[nodes])
                    np.add.at(total, clusters, tree.sum[nodes])
                np.add.at(n, to, 1)
                np.add.at(total, to, tree.points[rows])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _last(centroids: np.ndarray):
    """(vec_id, cluster, distance) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = _tree_of(batch, i, centroids.shape[1])
                whole, rows, to = assign(tree, centroids)
                cluster = np.empty(len(tree.points), np.int32)
                cluster[rows] = to
                for nodes, clusters in whole:
                    for node, c in zip(nodes.tolist(), clusters.tolist()):
                        cluster[tree.begin[node] : tree.end[node]] = c
                distance = ((tree.points - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`, in that order; of equal ids the smaller vector first, null ids as an empty text."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = kept.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()  # k vectors
    return np.array([r["v"] for r in found], np.int64)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of each cluster's mean; an empty cluster's stays."""
    each = trees.mapInArrow(_round(centroids), "cluster int, n long, total array<long>")
    sums = each.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for r in sums.collect():  # a row for each centroid and component
        out[r["cluster"], r["at"]] = r["x"] // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, width: int = 64, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that integers() keeps, repeated rows included.

    Null and short vectors, and those with a null or non-finite component, are
    left out; other columns of vectors don't matter. With fewer than k vectors
    each is a centroid; without any the result is empty. A null vec_id is kept.
    """
    with scratch(vectors.sparkSession):
        kept = stage(integers(vectors, width, scale, vec_id, embedding), "vectors")
        centroids = first_centroids(kept, k, seed)
        kind = dict(kept.dtypes)["vec_id"]
        layout = f"ids array<{kind}>, points binary, kind string, " + ", ".join(f"{n} binary" for n in _NODES)
        if len(centroids):
            trees = stage(kept.mapInArrow(_trees(width), layout), "trees")
            for _ in range(rounds):
                centroids = moved(trees, centroids)
            each = trees.mapInArrow(_last(centroids), f"vec_id {kind}, cluster int, distance long")
        else:
            each = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        each = stage(each, "assigned", outer=True)
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = vectors.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    own = each.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = own.agg(F.sum("cluster_inertia").alias("inertia"))
    small = F.broadcast(own.join(named, "cluster").crossJoin(whole))  # a row for each centroid
    return each.join(small, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
