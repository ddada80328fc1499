"""Benchmark decontamination: rare n-gram seeds, then local alignment.

One pass over the documents finds where n-grams of benchmark items occur, also
with one word put in between; words are numbered by the items' vocabulary, and
n-grams looked up as numbers. A document goes on with the items of which the
words around a seed hold enough. These hits give every seed's document count.
Rare seeds, and at least the rarer half of each item's, name the items that a
document is aligned with; an item of which it holds common seeds only, be it a
single one, is aligned too unless the words around the seeds, each counted as
often as the item has it, can't reach the least score. Smith-Waterman over
words, in the windows around all seeds, scores exact, edited and partly
paraphrased copies.

Three words a seed: a copy that reaches 0.6 by changed and left-out words has
three of the item's words in a row, if the item has nine or more. (With M words
kept and X not, 2 M - X >= 1.2 (M + X); so M >= 2.75 X, and of X + 1 runs one
has three.) Items below `shortest` words are too common to be copies: they match
a document that is the item and nothing else. Items are looked up in blocks of
about `block_words` words, so that a benchmark of any size passes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_key

_WORD = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2, -1, -1


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def numbered(words: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    """The words' numbers, -1 for those that no item has."""
    return np.fromiter((vocabulary.get(w, -1) for w in words), np.int64, len(words))


def grams_in(numbers: np.ndarray, size: int, n: int, gapped: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of the n-grams of known words; gapped: also of n + 1 words without one of those between the ends.

    size: of the vocabulary, of which the n-th power is below 2^63.
    """
    keys, places = [], []
    skips = [None, *range(1, n)] if gapped else [None]
    for skip in skips:
        width = n + (skip is not None)
        count = len(numbers) - width + 1
        if count <= 0:
            continue
        key, known = np.zeros(count, np.int64), np.ones(count, bool)
        for k in range(width):
            if k != skip:
                word = numbers[k : k + count]
                key = key * size + word
                known &= word >= 0
        at = np.flatnonzero(known)
        keys.append(key[at])
        places.append(at)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *keys]), np.concatenate([none, *places])


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of item within part (word numbers), and where in part it ends.

    A row at a time: gaps along the row are a running maximum.
    """
    if not len(item) or not len(part):
        return 0, 0
    steps = np.arange(len(part) + 1) * -GAP
    row = np.zeros(len(part) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(part == word, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def windows(hits: list[tuple[int, int]], length: int, limit: int) -> list[tuple[int, int]]:
    """Spans of a text of limit words in which an item of length words can lie, given (text position, item position) of seeds."""
    pad = length // 2 + 2
    spans = sorted((max(0, p - q - pad), min(limit, p - q + length + pad)) for p, q in hits)
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def similarity(item: list[str], text: list[str], hits: list[tuple[int, int]]) -> tuple[float, int, int]:
    """Best alignment score over that of the whole item, and the words of text that it spans at most."""
    numbers: dict[str, int] = {}
    own = np.array([numbers.setdefault(w, len(numbers)) for w in item])
    best = (0.0, 0, 0)
    for a, b in windows(hits, len(item), len(text)):
        score, end = align(own, np.array([numbers.get(w, -1) for w in text[a:b]]))
        if (share := score / (MATCH * len(item))) > best[0]:
            best = (share, max(a, a + end - len(item)), a + end)
    return best


def reachable(item: list[str], text: list[str], hits: list[tuple[int, int]]) -> float:
    """What similarity can't exceed: the largest share of the item's words that a window holds, in any order."""
    own = Counter(item)
    return max((MATCH * (own & Counter(text[a:b])).total() / (MATCH * len(item)) for a, b in windows(hits, len(item), len(text))), default=0.0)


class Block:
    """Benchmark items of one block, their vocabulary and seeds; sent to the tasks."""

    def __init__(self, items: list[list[str]], n: int, shortest: int) -> None:
        self.items, self.n = items, n
        self.short = {" ".join(w): [k for k, x in enumerate(items) if x == w] for w in items if 0 < len(w) < shortest}
        self.long = [k for k, w in enumerate(items) if len(w) >= shortest]
        self.vocabulary: dict[str, int] = {}
        for k in self.long:
            for w in items[k]:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.size = max(len(self.vocabulary), 1)
        if self.size**n >= 1 << 63:
            raise ValueError(f"{self.size} different words are too many for one block")
        self.sets = {k: np.unique(numbered(items[k], self.vocabulary)) for k in self.long}
        made = [grams_in(numbered(items[k], self.vocabulary), self.size, n, False) for k in self.long]
        key = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in made)])
        own = np.repeat(np.array(self.long, np.int64), [len(x) for x, _ in made])
        place = np.concatenate([np.zeros(0, np.int64), *(y for _, y in made)])
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.r_[first, len(key)]
        self.item, self.place = own[order], place[order]

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(seed, place) of the seeds in a text."""
        key, place = grams_in(numbers, self.size, self.n)
        if not len(self.keys):
            return key[:0], place[:0]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return at[found], place[found]

    def by_item(self, seeds: np.ndarray, places: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """(text position, item position) of the seeds, for each item."""
        found: dict[int, list[tuple[int, int]]] = {}
        for s, p in zip(seeds.tolist(), places.tolist()):
            for e in range(self.first[s], self.first[s + 1]):
                found.setdefault(int(self.item[e]), []).append((p, int(self.place[e])))
        return found

    def plausible(self, k: int, numbers: np.ndarray, hits: list[tuple[int, int]], least: float) -> bool:
        """Whether some window around the hits holds enough words of the item, in any order and number."""
        length = len(self.items[k])
        return any(int(np.isin(numbers[a:b], self.sets[k]).sum()) >= least * length for a, b in windows(hits, length, len(numbers)))


def _find_hits(block: Block, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seeds, places, whole = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                same = block.short.get(" ".join(words), []) if block.short and len(words) < 64 else []
                numbers = numbered(words, block.vocabulary)
                s, p = block.hits(numbers) if (numbers >= 0).any() else (np.zeros(0, np.int64),) * 2
                kept = {k for k, hits in block.by_item(s, p).items() if block.plausible(k, numbers, hits, least)} if len(s) else set()
                if kept:
                    of = np.array([bool(kept.intersection(block.item[block.first[x] : block.first[x + 1]].tolist())) for x in s.tolist()])
                    s, p = s[of], p[of]
                else:
                    s, p = s[:0], p[:0]
                if kept or same:
                    rows.append(i)
                    seeds.append(s.tolist())
                    places.append(p.tolist())
                    whole.append(same)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(seeds, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(whole, pa.list_(pa.int64()))], [*taken.schema.names, "seeds", "places", "whole"])

    return run


def _score(block: Block, rare: np.ndarray, least: float):
    """rare: of the block's seeds and items, pair by pair, whether the seed aligns without a look at the words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, out = batch.column("doc_id"), batch.column("text_key"), []
            for i, (text, seeds, places, whole) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "seeds", "places", "whole")))):
                named = {int(block.item[e]) for s in set(seeds) for e in range(block.first[s], block.first[s + 1]) if rare[e]}
                words = words_of(text)
                out += [(i, k, 1.0, 0, len(words)) for k in whole]
                for k, own in block.by_item(np.array(seeds, np.int64), np.array(places, np.int64)).items():
                    if k not in named and reachable(block.items[k], words, own) < least:
                        continue
                    share, a, b = similarity(block.items[k], words, own)
                    if share >= least:
                        out.append((i, k, share, a, b))
            rows = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            made = [pa.array(c, k) for c, k in zip(rows, kinds)]
            yield pa.RecordBatch.from_arrays([ids.take(made[0]), keys.take(made[0]), *made[1:]], ["doc_id", "text_key", "item", "similarity", "first_word", "end_word"])

    return run


def _middle(item: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each pair of item and count the median count of its item."""
    order = np.lexsort((count, item))
    own, back, size = np.unique(item, return_inverse=True, return_counts=True)
    start = np.cumsum(size) - size
    return count[order][start + size // 2][back] if len(own) else count


def _found(docs: DataFrame, benchmark: DataFrame, n: int = 3, rare_docs: int = 50, least: float = 0.6, shortest: int = 9, block_words: int = 500_000) -> DataFrame:
    """contaminated() with text_key."""
    spark = docs.sparkSession
    kinds = dict(docs.select("doc_id").dtypes) | dict(benchmark.select("item_id").dtypes)
    listed = benchmark.select("item_id", "text").where(F.col("text").rlike(r"\w"))
    total = listed.agg(F.sum(F.regexp_count("text", F.lit(r"\w+")))).first()[0] or 0
    blocks = -(-max(1, total) // block_words)
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    out = None
    for at in range(blocks):
        own = listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == at).collect()
        block = Block([words_of(r["text"]) for r in own], n, shortest)
        hits = stage(texts.mapInArrow(_find_hits(block, least), f"doc_id {kinds['doc_id']}, text string, text_key string, seeds array<long>, places array<int>, whole array<long>"), "hits")
        counted = hits.select(F.explode(F.array_distinct("seeds")).alias("seed")).groupBy("seed").count()
        docs_of = np.zeros(len(block.keys), np.int64)
        for seed, count in counted.collect():  # at most the block's seeds
            docs_of[seed] = count
        each = np.repeat(docs_of, np.diff(block.first))  # for each seed and item
        rare = each <= np.maximum(rare_docs, _middle(block.item, each))
        found = hits.mapInArrow(_score(block, rare, least), f"doc_id {kinds['doc_id']}, text_key string, item long, similarity double, first_word int, end_word int")
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(own)], f"item long, item_id {kinds['item_id']}")
        part = found.join(names, "item").select("doc_id", "text_key", "item_id", "similarity", "first_word", "end_word")
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, end_word): the documents that hold a copy of a benchmark item.

    docs: (doc_id, text); benchmark: (item_id, text). A document is aligned with
    an item if it holds a seed that occurs in at most rare_docs documents or is
    among the rarer half of the item's seeds (ties included), or any other of
    its seeds with enough of its words around; so rare_docs changes the work,
    not the result. similarity: the best local alignment's share
    of the item's own score (match 2, mismatch and gap -1), at least `least`;
    1 is a whole exact copy. first_word and end_word: the words of the text
    that the copy lies in. Null and empty texts, on either side, match nothing;
    repeated rows and repeated items give a row each; other columns of either
    side don't matter. Options: n, rare_docs, least, shortest, block_words.
    """
    return _found(docs, benchmark, **options).drop("text_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item; rows go by id (null too) and text."""
    found = _found(docs, benchmark, **options).select(F.col("doc_id").alias("_al_id"), F.col("text_key").alias("_al_key")).distinct()
    found = stage(found, "contaminated")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_al_id")) & (text_key(F.col("text")) == F.col("_al_key")), "left_anti")
