"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures, then exact comparison of whole sets.

A text's set holds the distinct shingles of its words. For each of `symbols`
hash functions the least shingle gives 16 bits of its signature, so two
signatures differ in each place with a probability of one less the sets'
Jaccard similarity. The signature-distance threshold is the least that a pair
at the similarity asked for exceeds with a probability of at most MISS; all
pairs within it are found, for certain:

The signature is cut into m chunks with errors + 1 of slack each, m (errors + 1)
> threshold; so two signatures within the threshold have a chunk that differs in
at most `errors` places. Each chunk gives a key for every choice of places that
may be wrong, of the other places' values. Texts that share a key are
candidates, and candidates within the threshold are compared as whole sets.

Equal sets are one row from the start. Of a group at a key, all are first
compared with its first member; classes come from what links. Where members of
a group are then in different classes, the signatures tell which classes have
members within the threshold, and connected ones are a family. A family's texts
are dealt once to the task that compares them (a large one in blocks, of which
those within its largest class never meet), and that gives links only, at most
one for each member. So no step gives all pairs of a group, and no link is lost.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import node_of, scratch, split_join, stage, text_key
from .simhash import SEED, classes

SYMBOLS, ERRORS = 64, 1
#: The probability with which a linked pair's signatures may be farther apart than the threshold.
MISS = 1e-10
_MIX = np.uint64(0x9E3779B97F4A7C15)


def threshold(symbols: int, percent: int, miss: float = MISS) -> int:
    """The least t such that more than t of the symbols differ with a probability of at most miss, at a similarity of percent / 100."""
    p, tail = 1 - percent / 100, 0.0
    for t in range(symbols, 0, -1):
        tail += math.comb(symbols, t) * p**t * (1 - p) ** (symbols - t)
        if tail > miss:
            return t
    return 0


def chunks(symbols: int, distance: int, errors: int) -> list[tuple[int, ...]]:
    """The places that each key has: for chunks that one pair of signatures within distance can't all differ in more than errors places of, all places but any `errors`."""
    m = min(distance // (errors + 1) + 1, symbols)
    cuts = [symbols * i // m for i in range(m + 1)]
    return [kept for x, y in itertools.pairwise(cuts) for kept in itertools.combinations(range(x, y), max(y - x - errors, 0))]


class Shingles:
    """Hashes of word shingles; a word is hashed once for many texts."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The distinct hashes of a UTF-8 text's word shingles, in order; of all words if there are fewer; none without words."""
        words = (text or b"").lower().split()  # of bytes: A-Z and the six ASCII spaces only
        if not words:
            return np.zeros(0, np.int64)
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > 500_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = digest(w, SEED)
        each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        n = len(words) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):  # a polynomial of the words' hashes, mixed at each step
            out = (out ^ each[k : k + n]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out.view(np.int64))


class Signatures:
    """The signature of a set: `symbols` values of 16 bits."""

    def __init__(self, symbols: int) -> None:
        made = np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(2 * symbols)], np.uint64)
        self.turn, self.by = made[:symbols], made[symbols:] | np.uint64(1)

    def __call__(self, own: np.ndarray) -> np.ndarray:
        least = np.full(len(self.by), np.iinfo(np.uint64).max)
        for at in range(0, len(own), 1024):
            least = np.minimum(least, ((own[at : at + 1024].view(np.uint64)[:, None] ^ self.turn) * self.by).min(axis=0))
        return ((least * _MIX) >> np.uint64(48)).astype(np.uint16)


def _signed(width: int, symbols: int):
    """(doc_id, text_key, digest, size, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, signature = Shingles(width), Signatures(symbols)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                own = [shingles(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
                columns = [batch.column("doc_id"), batch.column("text_key"), pa.array([xxhash.xxh128_digest(x.tobytes(), SEED) for x in own], pa.binary()), pa.array(list(map(len, own)), pa.int64()), pa.array([signature(x).tobytes() for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "digest", "size", "signature"])

    return run


def _values(signatures: pa.Array, symbols: int) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint16).reshape(len(signatures), symbols)


def _keys(places: list[tuple[int, ...]], symbols: int):
    """(key, id): the number of the choice of places, mixed with their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _values(batch.column("signature"), symbols).astype(np.uint64)
            for k, kept in enumerate(places):
                key = np.full(len(values), k, np.uint64)
                for place in kept:
                    key = (key ^ values[:, place]) * _MIX
                    key ^= key >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("id")], ["key", "id"])

    return run


def _within(symbols: int, distance: int):
    """(a, b) of the rows whose signatures are within the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_values(batch.column(f"signature_{x}"), symbols) for x in "ab")
            yield batch.select(["a", "b"]).filter(pa.array((a != b).sum(axis=1) <= distance))

    return run


class _Joined:
    """Disjoint sets of 0..n-1; root: each member's, up to date after every join."""

    def __init__(self, names: np.ndarray) -> None:
        _, first, back = np.unique(names, return_index=True, return_inverse=True)
        self.root = first[back]

    def join(self, x: int, y: int) -> bool:
        if self.root[x] == self.root[y]:
            return False
        self.root[self.root == self.root[y]] = self.root[x]
        return True


def _grouped(names: list[str], done):
    """Gives done() the rows of each value of the first two columns, from rows sorted by them; the group that a batch ends in waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(n).to_numpy(zero_copy_only=False) for n in names)
            change = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for begin, end in itertools.pairwise([0, *change.tolist(), batch.num_rows]):
                group = x[begin], y[begin]
                if rest and group != last:
                    yield done(pa.Table.from_batches(rest).combine_chunks().to_batches()[0])
                    rest = []
                last = group
                rest.append(batch.slice(begin, end - begin))
        if rest:
            yield done(pa.Table.from_batches(rest).combine_chunks().to_batches()[0])

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])


def _akin(symbols: int, distance: int, percent: int):
    """(a, b): classes of a key's group that have members within the distance, as a tree of each connected set of them."""

    def done(rows: pa.RecordBatch) -> pa.RecordBatch:
        sizes = rows.column("size").to_numpy()
        order = np.argsort(sizes, kind="stable")
        size, root, part = (rows.column(c).to_numpy()[order] for c in ("size", "root", "part"))
        sign = _values(rows.column("signature"), symbols)[order]
        several, joined, found = part.min() != part.max(), _Joined(root), []
        last = np.searchsorted(size, size * 100 // percent, side="right")
        step = max(1, (1 << 23) // (symbols * len(size)))
        for at in range(0, len(size), step):
            own, upto = np.arange(at, min(at + step, len(size))), last[min(at + step, len(size)) - 1]
            other = np.arange(at, upto)
            fine = (joined.root[own][:, None] != joined.root[other]) & (other > own[:, None]) & (other < last[own][:, None])
            if several:  # a cell of two parts has their common pairs only
                fine &= part[own][:, None] != part[other]
            if fine.any():
                fine &= (sign[own][:, None] != sign[other]).sum(axis=2, dtype=np.int16) <= distance
                for x, y in zip(*(v.tolist() for v in np.nonzero(fine))):
                    if joined.join(own[x], other[y]):
                        found.append((int(root[own[x]]), int(root[other[y]])))
        return _pairs(found)

    return _grouped(["key", "cell"], done)


#: Bits that a set's shingles are hashed into, to bound what two sets share from above.
_BITS = 1 << 14


def _compared(width: int, percent: int):
    """(a, b): links between members of different classes in a cell of a family, a tree of each class that they make."""
    shingles = Shingles(width)

    def done(rows: pa.RecordBatch) -> pa.RecordBatch:
        order = np.argsort(rows.column("size").to_numpy(), kind="stable")
        ids, root, size, part = (rows.column(c).to_numpy()[order] for c in ("id", "root", "size", "part"))
        texts = rows.column("text").cast(pa.binary()).take(pa.array(order))
        sets = [shingles(x.as_py()) for x in texts]
        bits = np.zeros((len(sets), _BITS // 64), np.uint64)
        for i, own in enumerate(sets):
            place = own.view(np.uint64) % np.uint64(_BITS)
            np.bitwise_or.at(bits[i], place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
        lost = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)  # shingles that share a bit with others of the set
        several, joined, found = part.min() != part.max(), _Joined(root), []
        last = np.searchsorted(size, size * 100 // percent, side="right")
        for i in range(len(sets)):
            other = np.arange(i + 1, last[i])
            other = other[joined.root[other] != joined.root[i]]
            if several:
                other = other[part[other] != part[i]]
            for at in range(0, len(other), 1024):
                some = other[at : at + 1024]
                most = np.bitwise_count(bits[some] & bits[i]).sum(axis=1, dtype=np.int64) + np.minimum(lost[some], lost[i])
                for j in some[(100 + percent) * most >= percent * (size[some] + size[i])].tolist():
                    if joined.root[i] != joined.root[j]:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if (100 + percent) * both >= percent * (len(sets[i]) + len(sets[j])):
                            joined.join(i, j)
                            found.append((int(ids[i]), int(ids[j])))
        return _pairs(found)

    return _grouped(["family", "cell"], done)


def _linked(width: int, percent: int):
    """(a, b) of the rows (a, b, of_a, of_b) whose texts reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        last: dict[str, tuple] = {"a": (None, None), "b": (None, None)}
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                sets = []
                for side in "ab":
                    name = batch.column(side)[k].as_py()
                    if last[side][0] != name:
                        last[side] = name, shingles(batch.column(f"of_{side}")[k].cast(pa.binary()).as_py())
                    sets.append(last[side][1])
                a, b = sets
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _ends(pairs: DataFrame, other: DataFrame, names: list[str]) -> DataFrame:
    """pairs with the columns of other (id, names...) for both ends."""
    for x in "ba":
        pairs = pairs.join(other.select(F.col("id").alias(x), *(F.col(n).alias(f"{n}_{x}") for n in names)), x)
    return pairs


def _texts_of(ids: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, text) of the sets in ids (id), each of its first row."""
    wanted = ids.distinct().join(sets, "id").select("id", F.col("first.id").alias("own"), F.col("first.key").alias("key"))
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(F.col("own")) & (F.col("text_key") == F.col("key"))).select("id", "text")
    return stage(found.dropDuplicates(["id"]), "texts")


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that link. Sorted by a, so that a first member's text is cut once."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    both = _ends(pairs, _texts_of(ids, sets, texts).withColumnRenamed("text", "of"), ["of"])
    return stage(both.sortWithinPartitions("a").mapInArrow(_linked(width, percent), "a long, b long"), "links")


def within_families(members: DataFrame, sets: DataFrame, texts: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """(root, least): which classes of members (root, id, size, family) all links between classes of one family join."""
    each = members.groupBy("family", "root").agg(F.count("*").alias("own"))
    each = each.groupBy("family").agg(F.sum("own").alias("all"), F.max_by("root", "own").alias("main"), F.max("own").alias("most"))
    # parts 0 to p - 1 have the largest class, whose members needn't meet; the others p to q - 1
    p, q = F.ceil(F.col("most") / block).cast("long"), F.ceil(F.col("most") / block).cast("long") + F.ceil((F.col("all") - F.col("most")) / block).cast("long")
    placed = members.join(each, "family").withColumn("p", p).withColumn("q", q)
    placed = placed.withColumn("part", F.when(F.col("root") == F.col("main"), F.pmod(F.xxhash64("id"), "p")).otherwise(F.col("p") + F.pmod(F.xxhash64("id"), F.col("q") - F.col("p"))))
    placed = placed.join(_texts_of(members.select("id"), sets, texts), "id")
    begin = F.when(F.col("part") < F.col("p"), F.col("p")).otherwise(F.lit(0).cast("long"))
    placed = placed.withColumn("other", F.explode(F.sequence(begin, F.col("q") - 1)))
    cell = F.least("part", "other") * F.col("q") + F.greatest("part", "other")
    placed = placed.select("family", cell.alias("cell"), "id", "root", "size", "part", "text").repartition("family", "cell").sortWithinPartitions("family", "cell")
    more = placed.mapInArrow(_compared(width, percent), "a long, b long").distinct()
    for x in "ab":
        more = more.join(members.select(F.col("id").alias(x), F.col("root").alias(f"of_{x}")), x)
    return classes(more.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("least"))


def labelled(rows: DataFrame, sets: DataFrame, rooted: DataFrame, total: int, empty_alike: bool) -> DataFrame:
    """What near_duplicates gives, from rows (doc_id, text_key, digest), their sets and each set's class: rooted (id, root)."""
    named = sets.join(rooted.select("id", "root"), "id", "left").select("digest", "n", "size", "first", F.coalesce("root", "id").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    labels = stage(named.join(least, "root").select("digest", "n", "size", "least"), "labels")
    out = split_join(rows.select("doc_id", "text_key", "digest"), labels, ["digest"], total)
    alone = (F.col("size") == 0) & F.lit(not empty_alike)
    component = lambda own, of: F.when(alone, F.col(own)).otherwise(F.col("least")[of])
    return out.select("doc_id", "text_key", F.col("size").alias("n_shingles"), component("doc_id", "id").alias("component_id"), component("text_key", "key").alias("component_key"))


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, empty_alike: bool = False, symbols: int = SYMBOLS, errors: int = ERRORS, block: int = 2048) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, component_key) for each row of docs (doc_id, text), repeated rows included.

    Sets with a Jaccard similarity of percent / 100 or more link. n_shingles:
    the size of the row's set. component_id: the smallest doc_id that links lead
    to, the row's own included; null ids count as largest. text_key: a hash of
    the text; component_key: that of the row with the smallest doc_id (of
    several, the smallest). Texts without words, null ones too, link with
    nothing, or with each other if empty_alike. An empty table gives an empty
    result; other columns of docs don't matter. Groups and families of more than
    `block` sets are divided into pairs of blocks.
    """
    with scratch(docs.sparkSession):
        return stage(_near_duplicates(docs, width, percent, empty_alike, symbols, errors, block), "groups", outer=True)


def _near_duplicates(docs: DataFrame, width: int, percent: int, empty_alike: bool, symbols: int, errors: int, block: int) -> DataFrame:
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    distance = threshold(symbols, percent)
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    rows = stage(texts.mapInArrow(_signed(width, symbols), f"doc_id {kind}, text_key string, digest binary, size long, signature binary"), "signed")
    total = rows.count()
    first = F.min(node_of(F.col("doc_id"), F.col("text_key"))).alias("first")
    sets = rows.groupBy("digest").agg(first, F.count("*").alias("n"), F.first("size").alias("size"), F.first("signature").alias("signature"))
    sets = stage(sets.withColumn("id", F.monotonically_increasing_id()), "sets")

    keys = sets.where("size > 0").select("signature", "id").mapInArrow(_keys(chunks(symbols, distance, errors), symbols), "key long, id long")
    groups = keys.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("members")).where("members > 1")
    met = stage(keys.join(groups, "key"), "met")

    def likely(pairs: DataFrame) -> DataFrame:
        both = _ends(pairs, sets, ["size", "signature"]).where(f"least(size_a, size_b) * 100 >= greatest(size_a, size_b) * {percent}")
        return stage(both.mapInArrow(_within(symbols, distance), "a long, b long"), "likely")

    tried = likely(met.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    found = classes(verified(tried, sets, texts, width, percent)).select(F.col("node").alias("id"), "root")
    rooted = stage(sets.where("size > 0").select("id", "size").join(found, "id", "left").select("id", "size", F.coalesce("root", "id").alias("root")), "rooted")

    # families: classes that have members within the distance in a group
    named = met.where("members > 2").join(rooted, "id")
    mixed = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    parts = F.ceil(F.col("members") / block).cast("long")
    own = named.join(mixed, "key").join(sets.select("id", "signature"), "id").withColumn("part", F.pmod(F.xxhash64("id"), parts))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    cell = F.least("part", "other") * parts + F.greatest("part", "other")
    dealt = spread.select("key", cell.alias("cell"), "root", "size", "part", "signature").repartition("key", "cell").sortWithinPartitions("key", "cell")
    akin = stage(dealt.mapInArrow(_akin(symbols, distance, percent), "a long, b long").distinct(), "akin")
    if not akin.isEmpty():
        families = classes(akin)
        families = families.union(families.select("root", "root").distinct()).toDF("root", "family")
        members = stage(rooted.join(families, "root"), "members")
        joined = within_families(members, sets, texts, width, percent, block)
        rooted = rooted.join(joined, "root", "left").select("id", F.coalesce("least", "root").alias("root"))

    return labelled(rows, sets, rooted, total, empty_alike)
