"""Phrase mining by hashed counting passes (PCY, DHP), and the collocation scores of what is frequent.

Pass k counts phrases of k words exactly, and in the same scan counts the
phrases of k + 1 words by hash: into `buckets` small counters a task, which are
summed slice by slice into a bitmap of the buckets that reach min_count. Pass
k + 1 counts a phrase only where its bucket is in that bitmap and both its parts
of k words are among the frequent ones (Apriori); these too are sent as a bitmap
of hashes. Both bitmaps have a bit for each bucket, whatever the data; what they
let through by chance costs work, and exact counts decide. Only phrases whose
parts both came through are hashed for the next pass.

The first pass cuts the texts and writes them as numbers of words, a dictionary
for each batch; the others read these. A task gives out each of its phrases once, and
a frequent phrase is in nearly every task; so these passes have a few tasks a core,
however many parts the texts are in, and get the texts a few batches at a time.

The counters bound what the filter can tell apart: with more than about
min_count occurrences a bucket nearly all buckets are set, and Apriori is left.
So there is a bucket for about every twenty words, up to MOST_BUCKETS; a task gives
out no more than its own distinct phrases, however many buckets there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, scratch, stage

SEED = 42
#: Buckets of a slice: a place in it has 16 bits.
SLICE = 1 << 16
#: Documents of a batch, and words and phrases a task holds before it gives them out.
_ROWS, _HELD = 512, 200_000
#: A pass over numbered texts: tasks for each core, characters of a task beyond that, rows (of a batch of documents each) that a task gets at once.
_TASKS, _TASK_CHARS, _GOT = 2, 1 << 30, 16
# What ends a piece, as bytes; 255 is in no UTF-8 text and stands for it.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_CUT = bytes.maketrans(_ENDS, b"\xff" * len(_ENDS))
_MIX = np.uint64(0x9E3779B97F4A7C15)


#: Buckets, at most: 4 MB as a bitmap, 128 MB as a task's counters.
MOST_BUCKETS = 1 << 25


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z lower-cased; b'\\xff' stands between pieces."""
    return text.lower().translate(_CUT).replace(b"\xff", b" \xff ").split()


class Words(dict):
    """Numbers of words, in the order in which they come; 0 is the end of a piece. spelt, table: the words and their hashes by number."""

    def __init__(self) -> None:
        super().__init__({b"\xff": 0})
        self.spelt, self.table = [b"\xff"], np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = xxhash.xxh64_intdigest(word, SEED)
        self.spelt.append(word)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _longer(hashed: np.ndarray, each: np.ndarray, k: int) -> np.ndarray:
    """Hashes of phrases of k words at each place, from those of k - 1 words and those of words."""
    n = max(len(each) - k + 1, 0)
    out = (hashed[:n] ^ each[k - 1 : k - 1 + n]) * _MIX
    return out ^ (out >> np.uint64(29))


def hashes(each: np.ndarray, group: bytes, k: int) -> list[np.ndarray]:
    """Hashes of the phrases of 0 (the group's own), 1, ... k words at each place."""
    out = [np.full(len(each), xxhash.xxh64_intdigest(group, SEED), np.uint64)]
    for i in range(1, k + 1):
        out.append(_longer(out[-1], each, i))
    return out


class Bits:
    """A bitmap of hashes, a bit for each bucket."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.buckets = bits, 8 * len(bits)

    def __call__(self, hashed: np.ndarray) -> np.ndarray:
        at = bucket(hashed, self.buckets)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) > 0


def bucket(hashed: np.ndarray, buckets: int) -> np.ndarray:
    return (hashed >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


_COUNTED = ("lang string", "phrase string", "n long")
_BUCKETS = ("slice int", "at binary", "counts binary")
_TEXTS = ("lang string", "words array<string>", "hashes binary", "ids binary")
#: What a pass gives: counted phrases, counters of buckets, and, of the first, texts as numbers.
_RAW = ", ".join(dict.fromkeys([*_COUNTED, *_BUCKETS, *_TEXTS]))
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def _number(words: int) -> np.dtype:
    """What a text's numbers of so many different words are written as."""
    return np.min_scalar_type(words)


def _raw(rows: int, /, **columns: pa.Array) -> pa.RecordBatch:
    names = [c.split(" ") for c in _RAW.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, _KINDS[kind]) for c, kind in names], [c for c, _ in names])


def _counted_rows(lang: str, phrases: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    return _raw(len(phrases), lang=pa.array([lang] * len(phrases), pa.string()), phrase=pa.array(phrases, pa.binary()).cast(pa.string()), n=pa.array(n, pa.int64()))


def _bucket_rows(counts: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Each slice of counters that isn't empty: places and counts, or all counts if that is shorter; counts from `most` on are alike."""
    kind = np.min_scalar_type(most)
    for k in range(0, len(counts), SLICE):
        own = np.minimum(counts[k : k + SLICE], most).astype(kind)
        some = np.flatnonzero(own)
        if len(some):
            dense = len(some) * (2 + kind.itemsize) >= own.nbytes
            at, n = (b"", own) if dense else (some.astype(np.uint16).tobytes(), own[some])
            yield _raw(1, slice=pa.array([k // SLICE], pa.int32()), at=pa.array([at], pa.binary()), counts=pa.array([n.tobytes()], pa.binary()))


def _first(most: int, buckets: int, hashed: bool):
    """Counts of words, texts as numbers and, if hashed, bucket counts of phrases of two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = Words(), {}
        counts = np.zeros(buckets if hashed else 0, np.uint32)

        def given() -> Iterator[pa.RecordBatch]:
            for lang, n in found.items():
                some = np.flatnonzero(n)
                yield _counted_rows(lang, [known.spelt[i] for i in some.tolist()], n[some])

        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                together: dict[str, list[bytes]] = {}
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                    if text:
                        own = together.setdefault(lang, [])
                        own += words_of(text)
                        own.append(b"\xff")
                for lang, words in together.items():
                    ids = known.numbers(words)
                    n = np.bincount(ids, minlength=len(known))
                    n[0] = 0
                    old = found.get(lang)
                    if old is not None:
                        n[: len(old)] += old
                    found[lang] = n
                    if hashed:
                        of = hashes(known.table[ids], lang.encode(), 2)[2]
                        np.add.at(counts, bucket(of[(ids[:-1] > 0) & (ids[1:] > 0)], buckets), 1)
                        here = np.zeros(len(known), np.int32)  # the batch's own numbers
                        here[ids] = 1
                        here[0] = 0
                        some = np.flatnonzero(here)
                        here[some] = np.arange(1, len(some) + 1)
                        order = [known.spelt[i] for i in some.tolist()]
                        yield _raw(1, lang=pa.array([lang], pa.string()), words=pa.array([order], pa.list_(pa.binary())).cast(pa.list_(pa.string())), hashes=pa.array([known.table[some].tobytes()], pa.binary()), ids=pa.array([here[ids].astype(_number(len(some))).tobytes()], pa.binary()))
                if len(known) > _HELD:
                    yield from given()
                    known, found = Words(), {}
        yield from given()
        yield from _bucket_rows(counts, most)

    return run


def _pass(k: int, most: int, buckets: int, hashed: bool, words: Bits, seen: Bits, parts: Bits):
    """Exact counts of the phrases of k words, k over 1, that seen and parts let through; if hashed, bucket counts of those of k + 1. words: the frequent ones."""

    def exact(spelt: pa.Array, ids: np.ndarray, own: np.ndarray, at: np.ndarray, found: Counter) -> None:
        group, _ = pd.factorize(own[at])
        n = np.bincount(group)
        first = np.empty(len(n), np.int64)
        first[group[::-1]] = at[::-1]
        for j in range(k):
            if (ids[at + j] != ids[first[group] + j]).any():  # two phrases of one hash: each by itself
                first, n = at, np.ones(len(at), np.int64)
                break
        named = np.unique(ids[(first[:, None] + np.arange(k)).ravel()])
        text = dict(zip(named.tolist(), spelt.take(pa.array(named - 1)).cast(pa.binary()).to_pylist()))
        for row, c in zip(ids[first[:, None] + np.arange(k)].tolist(), n.tolist()):
            found[b" ".join([text[i] for i in row])] += c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        counts = np.zeros(buckets if hashed else 0, np.uint32)
        for batch in batches:
            for i in range(batch.num_rows):
                lang = batch.column("lang")[i].as_py()
                table = np.frombuffer(batch.column("hashes")[i].as_py(), np.uint64)
                ids = np.frombuffer(batch.column("ids")[i].as_py(), _number(len(table))).astype(np.int64)
                often = np.r_[False, words(hashes(table, lang.encode(), 1)[1])]
                ids = np.where(often[ids], ids, 0)
                ids = ids[(ids > 0) | np.r_[True, ids[:-1] > 0]]  # one end in place of a run of rare words
                of = hashes(np.r_[np.uint64(0), table][ids], lang.encode(), k + hashed)
                inside = [ids > 0]
                for j in range(2, k + 1 + hashed):
                    inside.append(inside[-1][: len(of[j])] & inside[0][j - 1 :])
                passed = parts(of[k - 1])
                n = len(inside[k - 1])
                keep = inside[k - 1] & passed[:n] & passed[1 : n + 1]
                keep[keep] = seen(of[k][keep])
                at = np.flatnonzero(keep)
                if len(at):
                    exact(batch.column("words")[i].values, ids, of[k], at, found.setdefault(lang, Counter()))
                if hashed and n > 1:
                    np.add.at(counts, bucket(of[k + 1][keep[:-1] & keep[1:] & inside[k]], buckets), 1)
            if sum(map(len, found.values())) > _HELD:
                for lang, own in found.items():
                    yield _counted_rows(lang, list(own), np.array(list(own.values())))
                found = {}
        for lang, own in found.items():
            yield _counted_rows(lang, list(own), np.array(list(own.values()), np.int64))
        yield from _bucket_rows(counts, most)

    return run


def _marked(buckets: int):
    """Bucket rows of the phrases of rows (lang, phrase, size), all of one size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.uint32)
        for batch in batches:
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist()):
                each = np.array([xxhash.xxh64_intdigest(w, SEED) for w in phrase.split(b" ")], np.uint64)
                counts[bucket(hashes(each, lang.encode(), len(each))[-1], buckets)] = 1
        yield from _bucket_rows(counts, 1)

    return run


def _summed(most: int):
    """(slice, bits) of rows sorted by slice: which counters reach `most` in all."""
    kind = np.min_scalar_type(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, np.zeros(SLICE, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(sums >= most, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

        for batch in batches:
            for k, at, counts in zip(*(batch.column(c).to_pylist() for c in ("slice", "at", "counts"))):
                if k != last:
                    if last is not None:
                        yield done()
                    last, sums = k, np.zeros(SLICE, np.int64)
                own = np.frombuffer(counts, kind)
                if at:
                    sums[np.frombuffer(at, np.uint16)] += own
                else:
                    sums[: len(own)] += own
        if last is not None:
            yield done()

    return run


def bitmap(rows: DataFrame, most: int, buckets: int) -> Bits:
    """The buckets that reach `most` over all tasks' counters; a bit for each is sent to the driver."""
    dealt = rows.where("slice is not null").select("slice", "at", "counts").repartition("slice").sortWithinPartitions("slice")
    bits = np.zeros(max(buckets, 8) // 8, np.uint8)
    for r in dealt.mapInArrow(_summed(most), "slice int, bits binary").collect():
        own = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(bits)]
        bits[r["slice"] * SLICE // 8 :][: len(own)] = own
    return Bits(bits)


def frequent(docs: DataFrame, text: str = "text", group: str = "lang", min_count: int = 100, longest: int = 5, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of the phrases of 1 to `longest` words that a group has min_count times, (lang, n) words of each group).

    Phrases lie within pieces, occurrences may overlap. A null group is `und`,
    a null text is empty. buckets is a power of two, 8 at least; by default it
    follows the characters of all texts.
    """
    size = docs.agg(F.sum(F.length(F.col(f"`{text}`")))).first()[0] or 0
    if buckets is None:
        buckets = min(max(1 << 16, 1 << (size // 128).bit_length()), MOST_BUCKETS)
    if buckets < 8 or buckets & (buckets - 1):
        raise ValueError("buckets is a power of two, 8 at least")
    own = docs.select(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    tasks = max(_TASKS * docs.sparkSession.sparkContext.defaultParallelism, size // _TASK_CHARS)
    found, words, seen, parts, texts, totals = [], None, None, None, None, None
    for k in range(1, longest + 1):
        hashed = k < longest
        run = _first(min_count, buckets, hashed) if k == 1 else _pass(k, min_count, buckets, hashed, words, seen, parts)
        if k == 1:
            raw = stage(own.mapInArrow(run, _RAW), "pass1")
        else:
            with arrow_rows(docs.sparkSession, _GOT):
                raw = stage(texts.coalesce(tasks).mapInArrow(run, _RAW), f"pass{k}")
        counted = raw.where("phrase is not null").select("lang", "phrase", "n")
        if k == 1:
            totals = stage(counted.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
            texts = raw.where("ids is not null").select("lang", "words", "hashes", "ids")
        sums = stage(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count).select("lang", "phrase", F.lit(k).alias("size"), "f"), f"frequent{k}")
        found.append(sums)
        if hashed:
            if sums.isEmpty():
                break
            seen, parts = bitmap(raw, min_count, buckets), bitmap(sums.mapInArrow(_marked(buckets), _RAW), 1, buckets)
            words = words or parts
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole, totals


def _part(begin: str, size: str) -> str:
    return f"array_join(slice(split(phrase, ' '), {begin}, {size}), ' ')"


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", min_count: int = 100, longest: int = 5, top: int = 2000, buckets: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each group's first `top` phrases of two words and more.

    a: the phrase's count, n: the group's words. A cut after k words has counts
    l and r of its parts and the score floor(1000 a n / (l r)); the lowest
    scoring cut counts, of several the first. Phrases that a longer one holds
    as often are left out. Order: score, a, both descending, phrase by bytes.
    An empty table, or one without frequent phrases, gives an empty result.
    """
    with scratch(docs.sparkSession):
        every, totals = frequent(docs, text, group, min_count, longest, buckets)
        phrases = every.where("size > 1")
        longer = phrases.where("size > 2").select("lang", F.col("f").alias("of"), F.explode(F.array(F.expr(_part("1", "size - 1")), F.expr(_part("2", "size - 1")))).alias("phrase"))
        held = longer.groupBy("lang", "phrase").agg(F.max("of").alias("of"))
        own = phrases.join(held, ["lang", "phrase"], "left").where("of is null or of < f").join(totals, "lang")
        cuts = own.select("lang", "phrase", F.col("f").alias("a"), "n", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
        cuts = cuts.select("lang", "phrase", "a", "n", "k", F.expr(_part("1", "k")).alias("left"), F.expr(_part("k + 1", "size - k")).alias("right"))
        for side, name in (("left", "l"), ("right", "r")):
            cuts = cuts.join(every.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
        number = lambda c: f"cast({c} as decimal(18, 0))"
        score = F.expr(f"(1000BD * {number('a')} * {number('n')}) div ({number('l')} * {number('r')})")
        best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        place = F.row_number()
        some = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", place.over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
        first = some.drop("salt").withColumn("rank", place.over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)  # of 64 * top rows a group
        return stage(first.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", outer=True)
