"""SimHash near-duplicates: fingerprints, then links by the generalised pigeonhole principle.

A fingerprint takes the majority of each bit over the hashes of a text's word
shingles. Two of them link at `radius` differing bits or fewer.

The 64 bits are divided into m parts with a threshold t_i each; if the
thresholds sum to radius - m + 1, then any two fingerprints within the radius
agree on some part within that part's threshold (-1 leaves a part out). Bits
that vary together go to one part, a dynamic programme gives each part the
threshold with the least estimated work, and the best m is taken. Equal
fingerprints are merged before this, so that a group of exact copies is one
row.

Fingerprints are dealt by part and by the part's first `high` bits: each to
its own group, and as a probe to the groups within the threshold. In a group,
the remaining bits of the part name the candidates, which are compared in
whole; a group yields a star of links for each connected class, never all its
pairs. Groups beyond `block` rows are divided into pairs of blocks, so no task
gets more than two blocks of one group.

Classes come from alternating large-star and small-star steps over the links,
each step written to the shared folder; where nodes are numbers, tasks first
make forests of the links that they have.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, node_of, scratch, split_join, stage, text_key

BITS = 64
SEED = 42


def _majority(hashes: np.ndarray) -> bytes:
    counts, n = np.zeros(BITS, dtype=np.int64), len(hashes)
    raw = hashes.view(np.uint8).reshape(n, 8)
    for at in range(0, n, 8192):
        counts += np.unpackbits(raw[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Other 64 bits for each big-endian hash: the SplitMix64 finaliser."""
    z = hashes.astype(np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(">u8")


def fingerprint_bytes(text: bytes | None, width: int = 3, extra: int = 0, once: bool = False) -> bytes:
    """The fingerprint of a UTF-8 text, most significant byte first; zero bytes without words.

    extra: so many further words of 64 bits, from the hashes mixed again and
    again, follow. once: a shingle counts once, however often it comes.
    """
    words = (text or b"").lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return bytes(8 + 8 * extra)
    digest = xxhash.xxh64_digest
    join = b" ".join
    made = [digest(join(s), SEED) for s in zip(*(words[i:] for i in range(width)))] or [digest(join(words), SEED)]
    hashes = np.frombuffer(b"".join(dict.fromkeys(made) if once else made), dtype=">u8")
    out = [_majority(hashes)]
    for _ in range(extra):
        hashes = _mixed(hashes)
        out.append(_majority(hashes))
    return b"".join(out)


def fingerprints(docs: DataFrame, width: int = 3, extra: int = 0) -> DataFrame:
    """(doc_id, fp long, more binary) for each row of docs (doc_id, text); a null or empty text has zero bits only.

    more: the further words, 8 bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint_bytes(x, width, extra) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            fps = np.frombuffer(b"".join([x[:8] for x in made]), dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), pa.array([x[8:] for x in made], pa.binary())], ["doc_id", "fp", "more"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long, more binary")


def _words(more: pa.Array) -> np.ndarray:
    """A row of 64-bit words for each value."""
    values = more.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.uint64).reshape(len(values), -1) if values else np.zeros((0, 0), np.uint64)


def _bits(fps: np.ndarray) -> np.ndarray:
    """A row of 64 bits, bit 0 first, for each fingerprint."""
    return (fps.astype(np.uint64)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


@dataclass(frozen=True)
class Scheme:
    """Parts of the bits, and the threshold of each."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m parts of about equal width; each takes, again and again, the free bit that varies most with those it has."""
    spread = bits.std(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.abs(np.nan_to_num(np.corrcoef(bits, rowvar=False))) if len(bits) > 1 else np.zeros((BITS, BITS))
    np.fill_diagonal(c, 0)
    free, parts = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        part = [min(free, key=lambda x: (-spread[x], x))]
        free.discard(part[0])
        while len(part) < width:
            nxt = min(free, key=lambda x: (-c[x, part].sum(), x))
            part.append(nxt)
            free.discard(nxt)
        parts.append(sorted(part))
    return parts


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, tuple[int, ...]]:
    """The thresholds, one of costs[i] for each part i, that sum to total at the least cost."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for options in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for done, (cost, chosen) in best.items():
            for t, more in options.items():
                if (new := (cost + more, (*chosen, t))) < step.get(done + t, (np.inf, ())):
                    step[done + t] = new
        best = step
    return best.get(total, (np.inf, ()))


def _ball(bits: int, radius: int) -> int:
    return sum(math.comb(bits, k) for k in range(radius + 1))


def plan(sample: np.ndarray, rows: int, radius: int = 3, parts: range = range(2, 9), high: int = 3, row_cost: float = 1000.0, visit_cost: float = 20_000.0) -> Scheme:
    """The scheme with the least estimated work for `rows` fingerprints, of which `sample` is a part.

    Work is counted in candidates to compare: row_cost for each row that is
    dealt, visit_cost for each value of a part that is looked up. Candidates
    come from the pairs of the sample, and from independent bits where the
    sample is too small to show any.
    """
    bits = _bits(sample).astype(float) if len(sample) else np.zeros((1, BITS))
    few = sample[:1500]
    i, j = np.triu_indices(len(few), 1)
    apart = (few[i] ^ few[j]).view(np.uint64) if len(few) > 1 else np.zeros(0, np.uint64)
    p = bits.mean(axis=0)
    differ = np.clip(2 * p * (1 - p), 0.01, 0.5)
    best: tuple[float, Scheme] | None = None
    for m in parts:
        grouped = group_bits(bits, m)
        costs = []
        for part in grouped:
            mask = np.uint64(sum(1 << b for b in part))
            d = np.bitwise_count(apart & mask)
            dist = np.array([1.0])
            for b in part:
                dist = np.convolve(dist, [1 - differ[b], differ[b]])
            options = {-1: 0.0}
            for t in range(min(radius, len(part)) + 1):
                share = max(float((d <= t).mean()) if len(d) else 0.0, float(dist[: t + 1].sum()))
                dealt = rows * (1 + (_ball(high, t) - 1) / 2)
                visits = min(2.0 ** len(part), float(rows)) * _ball(max(0, len(part) - high), t)
                options[t] = row_cost * dealt + visit_cost * (visits if t else 0.0) + share * rows * rows / 2
            costs.append(options)
        cost, chosen = allocate(costs, radius - m + 1)
        if chosen and (best is None or cost < best[0]):
            best = cost, Scheme(tuple(map(tuple, grouped)), chosen)
    assert best is not None
    return best[1]


def _values(fps: np.ndarray, part: tuple[int, ...]) -> np.ndarray:
    """The part's bits of each fingerprint as a number, the part's first bit lowest."""
    return (_bits(fps)[:, list(part)] << np.arange(len(part), dtype=np.uint64)).sum(axis=1, dtype=np.uint64).astype(np.int64)


def _dealt(scheme: Scheme, high: int, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(part, group, rows, flips): which rows of fps go to which groups of each part, and how many group bits are flipped for it.

    Of two fingerprints in different groups, the one that has the lowest differing bit set goes to the other's.
    """
    for k, (part, t) in enumerate(zip(scheme.parts, scheme.thresholds)):
        if t < 0:
            continue
        g = min(high, len(part))
        own = _values(fps, part[:g])
        for n in range(min(t, g) + 1):
            for flip in itertools.combinations(range(g), n):
                rows = np.flatnonzero((own >> flip[0]) & 1) if flip else np.arange(len(fps))
                yield k, own[rows] ^ sum(1 << x for x in flip), rows, n


def _count_groups(scheme: Scheme, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for k, group, _, _ in _dealt(scheme, high, fps):
                values, counts = np.unique(group, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values), pa.array(counts.astype(np.int64))], ["part", "value", "n"])

    return run


def _deal(scheme: Scheme, high: int, blocks: dict[tuple[int, int], int]):
    """(part, value, cell, flips, fp, more). blocks: of large groups, in how many blocks each is divided; cell names a pair of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "value", "cell", "flips", "fp", "more"]
        for batch in batches:
            fps, more = batch.column("fp").to_numpy(zero_copy_only=False), batch.column("more")
            words = _words(more)
            at = _mixed(fps.view(np.uint64) ^ words[:, 0] if words.shape[1] else fps.view(np.uint64)).astype(np.uint64)
            for k, group, rows, n in _dealt(scheme, high, fps):
                cells = [(rows, group, np.zeros(len(rows), np.int64))]
                for (part, value), b in blocks.items():
                    if part == k and (hit := group == value).any():
                        _, _, cell = cells[0]
                        own = (at[rows[hit]] % np.uint64(b)).astype(np.int64)
                        for other in range(b):
                            pair = np.minimum(own, other) * b + np.maximum(own, other)
                            if other:
                                cells.append((rows[hit], group[hit], pair))
                            else:
                                cell[hit] = pair
                for r, v, cell in cells:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), k, np.int32)), pa.array(v), pa.array(cell), pa.array(np.full(len(r), n, np.int32)), pa.array(fps[r]), more.take(pa.array(r))], names)

    return run


class _Classes:
    """Disjoint sets of 0..n-1; root: each member's smallest, up to date after every join."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.root[a] != self.root[b]
        if not apart.any():
            return
        root = self.root
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
        while not np.array_equal(up := root[root], root):
            root[:] = up


def link_group(low: np.ndarray, flips: np.ndarray, fps: np.ndarray, more: np.ndarray, width: int, threshold: int, radius: int, both: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in a group: rows of each class's first member and of each other.

    low: the part's remaining `width` bits; flips: how many group bits a probe
    had flipped, 0 for the group's own rows. An own row is compared with every
    row whose low bits differ in at most threshold - flips; two rows link if
    fps differ in at most radius bits, and fps and more together in at most
    both.
    """
    order = np.lexsort((flips, low))
    key = (low * (threshold + 1) + flips)[order]
    f, m, v = fps[order].view(np.uint64), more[order], low[order]
    own = np.flatnonzero(flips[order] == 0)
    found = _Classes(len(key))
    masks = [(sum(1 << x for x in flip), n) for n in range(min(threshold, width) + 1) for flip in itertools.combinations(range(width), n)]

    def spans(values: np.ndarray, mask: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows to compare own rows of these values with, the mask flipped: own ones once, probes always."""
        to = values ^ mask
        return np.searchsorted(key, to * (threshold + 1) + (to < values)), np.searchsorted(key, to * (threshold + 1) + threshold - n + 1)

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        ok = found.root[a] != found.root[b]
        a, b = a[ok], b[ok]
        d = np.bitwise_count(f[a] ^ f[b])
        a, b, d = a[d <= radius], b[d <= radius], d[d <= radius]
        ok = d + np.bitwise_count(m[a] ^ m[b]).sum(axis=1, dtype=np.int64) <= both
        found.join(a[ok], b[ok])

    values, first, size = np.unique(v[own], return_index=True, return_counts=True)
    if len(values) and len(key) > 12 * len(values):
        begin, end = zip(*(spans(values, mask, n) for mask, n in masks))
        for i, (at, count) in enumerate(zip(first.tolist(), size.tolist())):
            mine = own[at : at + count]
            rest = np.concatenate([np.arange(b[i], e[i]) for b, e in zip(begin, end)])
            theirs = f[rest]
            for s in range(0, count, 16):
                few = mine[s : s + 16]
                r, c = np.nonzero(np.bitwise_count(f[few][:, None] ^ theirs) <= radius)
                compare(few[r], rest[c])
    else:
        for mask, n in masks:
            begin, end = spans(v[own], mask, n)
            begin = np.maximum(begin, own + 1) if mask == 0 else begin
            count = np.maximum(end - begin, 0)
            total = np.cumsum(count)
            for s in range(0, len(own), 1 << 16):
                c = count[s : s + (1 << 16)]
                a = np.repeat(own[s : s + (1 << 16)], c)
                step = np.arange(len(a)) - np.repeat(total[s : s + (1 << 16)] - c - (total[s - 1] if s else 0), c)
                compare(a, np.repeat(begin[s : s + (1 << 16)], c) + step)
    other = np.flatnonzero(found.root != np.arange(len(key)))
    return order[found.root[other]], order[other]


def _matches(scheme: Scheme, high: int, radius: int, both: int):
    def done(groups: list[pa.RecordBatch]) -> pa.RecordBatch:
        """One group, in pieces."""
        whole = pa.Table.from_batches(groups).combine_chunks()
        part, flips, fps = (whole.column(x).to_numpy() for x in ("part", "flips", "fp"))
        more = whole.column("more").combine_chunks()
        bits, threshold = scheme.parts[part[0]], scheme.thresholds[part[0]]
        rest = bits[min(high, len(bits)) :]
        a, b = link_group(_values(fps, rest), flips.astype(np.int64), fps, _words(more), len(rest), threshold, radius, both)
        return pa.RecordBatch.from_arrays([pa.array(fps[a]), more.take(pa.array(a)), pa.array(fps[b]), more.take(pa.array(b))], ["a", "a_more", "b", "b_more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by group; the group that a batch ends in is kept for the next batch."""
        rest: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("part", "value", "cell")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for x, y in itertools.pairwise([0, *change.tolist(), batch.num_rows]):
                group = tuple(int(k[x]) for k in keys)
                if rest and group != last:
                    yield done(rest)
                    rest = []
                last = group
                rest.append(batch.slice(x, y - x))
        if rest:
            yield done(rest)

    return run


def links(distinct: DataFrame, radius: int = 3, both: int = BITS, block: int = 262_144, sample_rows: int = 20_000) -> DataFrame:
    """(a, a_more, b, b_more): links between the fingerprints in distinct (fp, more; each once) whose classes are those of all links.

    sample_rows bounds the fingerprints that the scheme is fitted on; every
    fingerprint is dealt. The groups of a part are 2^high, 8 and more, so that
    one has some 2^16 fingerprints of its own.
    """
    rows = distinct.count()
    sample = np.array([r[0] for r in bounded_sample(distinct.select("fp"), F.col("fp"), sample_rows).collect()], dtype=np.int64)
    high = max(3, math.ceil(math.log2(max(rows, 1) / 65_536)))
    scheme = plan(sample, rows, radius, high=high)
    counts = distinct.select("fp").mapInArrow(_count_groups(scheme, high), "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n"))
    blocks = {(r["part"], r["value"]): -(-r["n"] // block) for r in counts.where(F.col("n") > block).collect()}  # at most rows / block of them
    dealt = distinct.select("fp", "more").mapInArrow(_deal(scheme, high, blocks), "part int, value long, cell long, flips int, fp long, more binary")
    dealt = dealt.repartition("part", "value", "cell").sortWithinPartitions("part", "value", "cell")
    return dealt.mapInArrow(_matches(scheme, high, radius, both), "a long, a_more binary, b long, b_more binary").distinct()


#: Edges of a task, and those that it makes a forest of at once.
_EDGES = 1 << 16


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): of some _EDGES edges (a, b) at a time, one to each node from the smallest that they lead to."""

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        names, at = np.unique(np.concatenate([x.column(c).to_numpy() for c in "ab" for x in held]), return_inverse=True)
        found, (a, b) = _Classes(len(names)), np.split(at, 2)
        for s in range(0, len(a), 1 << 12):
            found.join(a[s : s + (1 << 12)], b[s : s + (1 << 12)])
        other = np.flatnonzero(found.root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[found.root[other]]), pa.array(names[other])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= _EDGES:
            yield done(held)
            held = []
    if held:
        yield done(held)


def classes(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, root) for each node of edges (a, b) but the roots: the smallest node that it is connected to.

    Alternates large-star and small-star steps until all classes are stars: each
    node has greater neighbours only, or a single one, which is smaller. The
    centre of a large class has an edge to each of its nodes; such are split
    from the rest. Each step is a short plan of its own over a staged table, as
    each shuffle and broadcast of a plan takes memory of the driver. Between
    these steps tasks of _EDGES edges make forests of them where nodes are
    numbers, so that few steps are left.
    """
    numbers = dict(edges.dtypes)["a"] == "bigint"

    def forest(df: DataFrame) -> DataFrame:
        return df.mapInArrow(_forest, "a long, b long")

    edges = edges.where("a <> b")
    edges = stage(forest(edges) if numbers else edges, "edges")
    for step in range(most):
        both = edges.union(edges.select("b", "a"))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("last"), F.count("*").alias("n")), "least")
        total, largest, unsettled = least.agg(F.sum("n"), F.max("n"), F.count_if(F.expr("m < a and m < last"))).first()
        if not unsettled:
            return least.where("m < a").select(F.col("a").alias("node"), F.col("m").alias("root"))
        if numbers and step % 2 == 0:
            edges = stage(forest(edges.coalesce(-(-total // 2 // _EDGES))), "edges")
            continue
        up = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        large = split_join(up, least.select("a", F.least("a", "m").alias("m"), "n"), ["a"], total, largest=largest)
        large = stage(large.select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = small.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        small = small.where("a <> b")
        edges = stage(forest(small) if numbers else small.distinct(), "edges")
    raise RuntimeError(f"classes have not settled after {most} steps")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, extra: int = 0, both: int = BITS, block: int = 262_144) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text), repeated rows included.

    fingerprint: 16 lowercase hex digits, zeros for a text without words (null
    and empty ones too), which links like any other. component_id: the smallest
    doc_id that links lead to, the row's own included; null ids never count as
    smallest. An empty table gives an empty result.

    extra: further words of 64 bits; a link then also needs at most `both`
    differing bits in all. For a radius beyond a few bits, unrelated texts come
    within it by chance, and 64 bits tell a similarity roughly; the further
    bits verify.
    """
    fps = stage(fingerprints(docs, width, extra), "fingerprints")
    first = node_of(F.col("doc_id"), F.struct("fp", "more"))
    distinct = stage(fps.groupBy("fp", "more").agg(F.count("*").alias("n"), F.min(first).alias("node")), "distinct")
    pairs = links(distinct, radius, both, block)
    ids = distinct.select("fp", "more", "node")
    for side in "ab":
        named = ids.toDF(side, f"{side}_more", f"{side}_node")
        pairs = pairs.join(named, [side, f"{side}_more"])
    found = classes(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    labels = distinct.join(found, "node", "left").select("fp", "more", "n", F.coalesce("root", "node")["id"].alias("component_id"))
    total = fps.count()
    out = split_join(fps, stage(labels, "labels"), ["fp", "more"], total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: How the pipeline's similar texts are found: bits that fingerprints over three-word shingles may differ in, further words of 64 bits, and bits in all.
RADIUS, EXTRA, BOTH = 12, 2, 56


def _printed(width: int, extra: int):
    """(doc_id, text_key, digest, size, fp, more): the set of shingles of `width` words, and the fingerprint of the text's three-word ones, each once."""
    from .minhash import Shingles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                sets = [shingles(x) for x in texts]
                made = [fingerprint_bytes(x, 3, extra, once=True) for x in texts]
                digests = pa.array([xxhash.xxh128_digest(x.tobytes(), SEED) for x in sets], pa.binary())
                fps = np.frombuffer(b"".join([x[:8] for x in made]), dtype=">i8").astype(np.int64)
                columns = [batch.column("doc_id"), batch.column("text_key"), digests, pa.array(list(map(len, sets)), pa.int64()), pa.array(fps), pa.array([x[8:] for x in made], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "digest", "size", "fp", "more"])

    return run


def similar(docs: DataFrame, width: int = 5, percent: int = 80, radius: int = RADIUS, extra: int = EXTRA, both: int = BOTH, block: int = 2048) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, component_key) for each row of docs (doc_id, text), as minhash.near_duplicates gives them.

    The generalised pigeonhole join makes classes of the fingerprints that link
    (`radius` bits of the first word, `both` in all); texts of one class link if
    their whole sets of shingles of `width` words have a Jaccard similarity of
    percent / 100. All of a class are compared with its first text, then those
    that are still apart with each other, a class of more than `block` texts in
    pairs of blocks. Texts without words are alike.
    """
    with scratch(docs.sparkSession):
        return stage(_similar(docs, width, percent, radius, extra, both, block), "groups", outer=True)


def _similar(docs: DataFrame, width: int, percent: int, radius: int, extra: int, both: int, block: int) -> DataFrame:
    from . import minhash

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    rows = stage(texts.mapInArrow(_printed(width, extra), f"doc_id {kind}, text_key string, digest binary, size long, fp long, more binary"), "printed")
    total = rows.count()
    first = F.min(node_of(F.col("doc_id"), F.col("text_key"))).alias("first")
    same = (F.first(c).alias(c) for c in ("size", "fp", "more"))  # of one set, one fingerprint
    sets = rows.groupBy("digest").agg(first, F.count("*").alias("n"), *same)
    sets = stage(sets.withColumn("id", F.monotonically_increasing_id()), "sets")

    distinct = stage(sets.where("size > 0").groupBy("fp", "more").agg(F.min("id").alias("node"), F.count("*").alias("n")), "distinct")
    pairs = links(distinct, radius, both)
    for side in "ab":
        pairs = pairs.join(distinct.select(F.col("fp").alias(side), F.col("more").alias(f"{side}_more"), F.col("node").alias(f"{side}_node")), [side, f"{side}_more"])
    found = classes(pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")))
    family = distinct.join(found, "node", "left").select("fp", "more", "n", F.coalesce("root", "node").alias("family"))
    several = family.groupBy("family").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("family")
    own = stage(sets.where("size > 0").select("id", "size", "fp", "more").join(family.join(several, "family"), ["fp", "more"]).select("id", "size", "family"), "families")

    tried = own.where("id <> family").select(F.col("family").alias("a"), F.col("id").alias("b"))
    joined = classes(minhash.verified(tried, sets, texts, width, percent)).select(F.col("node").alias("id"), "root")
    members = stage(own.join(joined, "id", "left").select("id", "size", "family", F.coalesce("root", "id").alias("root")), "members")
    apart = members.groupBy("family").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2").select("family")
    open_ = stage(members.join(apart, "family"), "open")
    rooted = members.select("id", "root")
    if not open_.isEmpty():
        more = minhash.within_families(open_, sets, texts, width, percent, block)
        rooted = rooted.join(more, "root", "left").select("id", F.coalesce("least", "root").alias("root"))
    return minhash.labelled(rows, sets, rooted, total, empty_alike=True)


def keep_first(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of docs, all columns, that are the first (smallest doc_id, null last) of their group; of rows with one id and text, one stays.

    A group: texts that similar() links in any number of steps, by SimHash and
    then by a Jaccard similarity of 0.8 or more over distinct shingles of
    `width` words.
    """
    found = similar(docs, width)
    own = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("component_key"))
    counted = found.groupBy("doc_id", "text_key").agg(F.bool_or(own).alias("stays"), F.count("*").alias("n"))
    odd = stage(counted.where("not stays or n > 1").select(F.col("doc_id").alias("_al_id"), F.col("text_key").alias("_al_key"), F.col("stays").alias("_al_stays")), "later")
    at = F.col("doc_id").eqNullSafe(F.col("_al_id")) & (text_key(F.col("text")) == F.col("_al_key"))
    kept = docs.join(odd, at, "left_anti")
    twice = odd.where("_al_stays")
    if twice.isEmpty():
        return kept
    again = docs.join(twice, at).dropDuplicates(["_al_id", "_al_key"])
    return kept.unionByName(again.select(docs.columns))
