"""Exact BM25 top-k search over sharded inverted indexes with block-max WAND pruning.

Queries are whole texts. Their distinct words go to all tasks, which write each
document's known words by number to the shared folder, once; only more words than
a task may hold mean blocks of queries, each with an index of its own. From it come
the documents that have each term. The queries go through the index some at a time;
a task cuts its documents into parts of bounded size, and a part into shards of
documents that are alike (by the words that are theirs most often). A shard has an
inverted index, with idf and mean length of the whole corpus in its impacts. A list
is cut into cells, its postings in one block of `block_docs` documents, each with its
largest impact. A query takes the shard first that may hold its best, which gives a
threshold (the k-th best score so far in this task); then

* Shards whose lists' maxima sum to less than the threshold are passed unread.
* Long lists, of words that a fair share of the shard's documents have, are also held
  by document; a product of matrices sums them for some queries at once. Lists with
  few postings a block are read at once, as their cells would be nearly as many. Both
  stand in all bounds below by their sums, which are tighter than any maxima.

and for the other lists, a few batches of blocks at a time instead of one document:

* Shallow: the cells' maxima give each block's bound. Blocks below the threshold
  are passed without a look at their postings; the others go by falling bound, so
  that the threshold rises early.
* Pivot: the terms whose maxima sum to less than the threshold (and the best sum so
  far) leaves open can't carry a document alone. The others' postings are read; a document goes on if these and
  its block's maxima of the light terms reach the threshold.
* Deep: light postings are read only in blocks where a document goes on. Those
  that still reach the threshold are scored from their own terms.

Final scores use statistics of the whole corpus and are summed in one order, so
they don't depend on the shards, and merging the tasks' k best is exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

_WORD = re.compile(r"\w+")
SLACK = 1e-9
#: A list is long from a document in so many on; of a shard so many lists, at most, are held by document (64 MB at 16,384 documents).
LONG, MOST_LONG = 32, 1024
#: Several times what sums of MOST_LONG positive numbers in single precision can be off, relatively.
ROUNDED = 4e-4
#: Lists of fewer postings a block than these have no cells: they are read at once.
SPARSE = 4
#: Queries whose long lists are summed at once, and about how many postings of other lists.
_QUERIES, _POSTINGS = 128, 1 << 18
#: Texts of about so many words are numbered at once.
_WORDS = 1 << 18
#: A part is cut into so many shards at most, of about so many documents at least and a share of the part's.
MOST_SHARDS, LEAST_DOCS, LEAST_SHARE = 8, 256, 32


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Counter(words_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("query_id"), pa.array([sorted(c) for c in counts], pa.list_(pa.string())), pa.array([[c[w] for w in sorted(c)] for c in counts], pa.list_(pa.int32()))],
            ["query_id", "terms", "counts"],
        )


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] numbers, then the same from first[1] on, ..."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Shard:
    """Documents by position: forward index (terms ascending within a document), inverted lists, and their cells."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray, mean: float, k1: float, b: float, block_docs: int) -> None:
        self.ids, n = ids, len(ids)
        self.start, self.terms = np.r_[0, np.cumsum(sizes)], terms
        tf = counts.astype(float)
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
        norm = k1 * (1 - b + b * lengths.astype(float) / max(mean, 1e-12))
        self.impact = idf[terms] * tf * (k1 + 1) / (tf + norm[doc])
        order = terms.astype(np.int64) << 32
        order += np.arange(len(terms))
        order.sort()
        order &= 0xFFFFFFFF
        self.doc, self.inverted = doc[order], self.impact[order]
        df = np.bincount(terms, minlength=len(idf))
        self.begin = np.r_[0, np.cumsum(df)].astype(np.int32)  # of each term's list
        has = np.flatnonzero(df)
        self.term_max = np.zeros(len(idf))
        if len(has):
            self.term_max[has] = np.maximum.reduceat(self.inverted, self.begin[has])
        self.blocks, self.block_start = -(-n // block_docs), np.arange(0, n, block_docs)
        self.block_of = np.arange(n, dtype=np.int32) // block_docs
        self.block_size = np.diff(np.r_[self.block_start, n])
        long = has[df[has] * LONG >= max(n, 1)]
        long = long[np.argsort(-df[long], kind="stable")[:MOST_LONG]]
        self.long_at = np.full(len(idf), -1, np.int32)  # a term's row in long, or -1
        self.long_at[long] = np.arange(len(long))
        self.long = np.zeros((len(long), n), np.float32)
        for row, t in zip(self.long, long):
            row[self.doc[self.begin[t] : self.begin[t + 1]]] = self.inverted[self.begin[t] : self.begin[t + 1]]

    @cached_property
    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each cell its first posting, size, largest impact and block; of each term its first cell."""
        own = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))
        cell = own * max(self.blocks, 1) + self.block_of[self.doc]
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(self.inverted, start) if len(cell) else np.zeros(0)
        first = np.searchsorted(start, self.begin)
        return start, np.diff(np.r_[start, len(cell)]), most, self.block_of[self.doc[start]], first

    def bounds(self, at: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The most that a document can score, by the lists' maxima, for each of the queries that begin at these places."""
        return np.add.reduceat(self.term_max[terms] * weights, at) if len(at) else np.zeros(0)

    def long_sums(self, asked: list) -> np.ndarray:
        """For each query (id, terms, weights) and document, at least its score from the long lists, by ROUNDED more at most."""
        of = np.zeros((len(asked), len(self.long)), np.float32)
        for row, (_, terms, weights) in zip(of, asked):
            at = self.long_at[terms]
            row[at[at >= 0]] = weights[at >= 0]
        used = of.any(axis=0)
        few = 2 * np.count_nonzero(used) < len(used)
        sums = of[:, used] @ self.long[used] if few else of @ self.long
        sums *= np.float32(1 + ROUNDED / 2)
        return sums

    def partial(self, first: np.ndarray, size: np.ndarray, weights: np.ndarray, row: np.ndarray | int = 0, rows: int = 1) -> np.ndarray:
        """For each query and document, the score from these runs of postings, each times its weight; row: the first place of the run's query."""
        at, n = _spans(first, size), len(self.ids)
        place = self.doc[at] + np.repeat(row, size) if rows > 1 else self.doc[at]
        return np.bincount(place, self.inverted[at] * np.repeat(weights, size), rows * n).reshape(rows, n)

    def full(self, docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Whole scores of some documents; dense: the query's weight of each term."""
        size = self.start[docs + 1] - self.start[docs]
        out = np.zeros(len(docs))
        has = np.flatnonzero(size)
        if len(has):
            n = size[has]
            at = _spans(self.start[docs[has]], n)
            out[has] = np.add.reduceat(dense[self.terms[at]] * self.impact[at], np.cumsum(n) - n)
        return out


class Best:
    """The k best (score, id) of a query so far: higher scores first, then smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    @property
    def threshold(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else 0.0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, -s))[: self.k]
        order = order[s[order] > 0]
        self.scores, self.ids = s[order], i[order]


def evaluate(shard: Shard, terms: np.ndarray, weights: np.ndarray, best: Best, dense: np.ndarray, sums: np.ndarray | None = None) -> int:
    """Bring the query's best up to date with a shard; returns how many of its postings were read.

    sums: the query's row of long_sums; without it, long lists are read as the others are.
    """
    return evaluate_some(shard, [(0, terms, weights)], [best], dense, None if sums is None else sums[None])


def evaluate_some(shard: Shard, asked: list, best: list[Best], dense: np.ndarray, sums: np.ndarray | None = None) -> int:
    """The same for some queries (id, terms, weights) at once; sums: their rows of long_sums."""
    n, rows, slack = len(shard.ids), np.arange(len(asked)), SLACK + (0 if sums is None else ROUNDED)
    length = np.array([len(own) for _, own, _ in asked])
    terms, weights, of = np.concatenate([q[1] for q in asked]), np.concatenate([q[2] for q in asked]), np.repeat(rows, length)
    begin = np.cumsum(length) - length
    first = shard.begin[terms]
    size = shard.begin[terms + 1] - first
    left = size > 0 if sums is None else (size > 0) & (shard.long_at[terms] < 0)
    most_of_term = shard.term_max[terms] * weights
    most = np.bincount(of[left], most_of_term[left], len(asked)) + (0 if sums is None else sums.max(axis=1))
    floors = np.array([o.threshold for o in best]) * (1 - SLACK)
    live = (most > 0) & (most >= floors)
    left &= live[of]
    in_blocks = left & (size >= SPARSE * shard.blocks)
    left &= ~in_blocks
    read, sparse = int(size[left].sum()), np.flatnonzero(left)
    upto = np.cumsum(np.bincount(of[left], size[left], len(asked)))
    for own in np.split(rows, np.flatnonzero(np.diff(upto // _POSTINGS)) + 1):
        if not live[own].any():
            continue
        some = sparse[slice(*np.searchsorted(of[sparse], [own[0], own[-1] + 1]))]
        base = shard.partial(first[some], size[some], weights[some], (of[some] - own[0]) * n, len(own))
        if sums is not None:
            base = np.add(base, sums[own], out=base if len(some) else None)
        floor = np.where(live[own], floors[own], np.inf)
        goes_on = base >= floor[:, None]
        if (floor <= 0).any():
            goes_on &= base > 0
        hit, docs = np.divmod(np.flatnonzero(goes_on), n)
        bounds = np.searchsorted(hit, np.arange(len(own) + 1))
        for q, score, i, j in zip(own.tolist(), base, bounds[:-1].tolist(), bounds[1:].tolist()):
            rest = np.flatnonzero(in_blocks[begin[q] : begin[q] + length[q]]) + begin[q]
            if i == j and not len(rest):
                continue
            every = terms[begin[q] : begin[q] + length[q]]
            dense[every] = weights[begin[q] : begin[q] + length[q]]
            if len(rest):
                read += _by_blocks(shard, terms[rest], weights[rest], most_of_term[rest], best[q], dense, score, slack)
            else:
                _take(shard, docs[i:j], score, floor[q - own[0]], best[q], dense, slack)
            dense[every] = 0
    return read


def _take(shard: Shard, docs: np.ndarray, score: np.ndarray, floor: float, best: Best, dense: np.ndarray, slack: float) -> None:
    """Score some documents exactly, but for those that their sums so far, which are over by slack at most, leave behind k others."""
    if len(docs) > best.k:
        kth = np.partition(score[docs], len(docs) - best.k)[len(docs) - best.k]
        docs = docs[score[docs] >= max(floor, float(kth) * (1 - slack))]
    if len(docs):
        best.add(shard.full(docs, dense), shard.ids[docs])


def _by_blocks(shard: Shard, terms: np.ndarray, weights: np.ndarray, most_of_term: np.ndarray, best: Best, dense: np.ndarray, base: np.ndarray, slack: float) -> int:
    """A query's lists that have cells, a few batches of blocks at a time; base: what each document has from its other lists."""
    cell_start, cell_size, cell_max, cell_block, cell_first = shard.cells
    size = cell_first[terms + 1] - cell_first[terms]
    cells = _spans(cell_first[terms], size)
    which = np.repeat(np.arange(len(terms)), size)
    block, weight = cell_block[cells], weights[which]
    most = cell_max[cells] * weight
    of_block = np.maximum.reduceat(base, shard.block_start)
    bound = np.bincount(block, most, shard.blocks) + of_block
    order = np.argsort(-bound, kind="stable")
    order = order[: np.count_nonzero(bound)]
    ascending = np.argsort(most_of_term, kind="stable")
    summed = np.cumsum(most_of_term[ascending])
    read, at, step = 0, 0, max(1, len(order) // 8)
    while at < len(order):
        floor = best.threshold * (1 - SLACK)
        own = order[at : at + step]
        at, step = at + step, 3 * step
        own = own[bound[own] >= floor]
        if not len(own):
            break  # bounds fall
        mark = np.zeros(shard.blocks, bool)
        mark[own] = True
        light = np.zeros(len(terms), bool)
        light[ascending[summed < floor - of_block[own].max()]] = True
        inside, light_cell = mark[block], light[which]
        heavy = np.flatnonzero(inside & ~light_cell)
        score = shard.partial(cell_start[cells[heavy]], cell_size[cells[heavy]], weight[heavy])[0]
        score = score + np.where(np.repeat(mark, shard.block_size), base, 0)
        read += int(cell_size[cells[heavy]].sum())
        if light.any():
            rest = np.flatnonzero(inside & light_cell)
            reach = np.bincount(block[rest], most[rest], shard.blocks)
            on = np.flatnonzero((score > 0) & (score + np.repeat(reach, shard.block_size) >= floor))
            mark[:] = False
            mark[shard.block_of[on]] = True
            rest = rest[mark[block[rest]]]
            read += int(cell_size[cells[rest]].sum())
            score[on] += shard.partial(cell_start[cells[rest]], cell_size[cells[rest]], weight[rest])[0][on]
        _take(shard, np.flatnonzero(score >= floor if floor > 0 else score > 0), score, floor, best, dense, slack)
    return read


def alike(sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The documents of a part (by position, ascending) in some groups: each goes to that of a few words which it has most often.

    A word has a group if it is the most frequent one of enough documents that have none of the words before it.
    """
    n = len(sizes)
    least = max(LEAST_DOCS, n // LEAST_SHARE)
    doc, has = np.repeat(np.arange(n), sizes), np.flatnonzero(sizes)
    key = (counts.astype(np.int64) << 32) - terms
    mode = np.full(n, -1, np.int64)
    if len(has):
        mode[has] = -np.maximum.reduceat(key, (np.cumsum(sizes) - sizes)[has]) & 0xFFFFFFFF
    group, most, left = np.full(n, -1), np.zeros(n, np.int64), mode >= 0
    for head in range(MOST_SHARDS - 1):
        modes, n_modes = np.unique(mode[left], return_counts=True)
        if not len(modes) or n_modes.max() < least:
            break
        at = np.flatnonzero(terms == modes[n_modes.argmax()])
        own, n_own = doc[at], counts[at]
        more = n_own > most[own]
        group[own[more]], most[own[more]] = head, n_own[more]
        left[own] = False
    return [own for g in range(-1, MOST_SHARDS - 1) if len(own := np.flatnonzero(group == g))]


def _index(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, length, terms, counts): each document's known words by number, ascending."""
        get = vocabulary.value.get

        def packed(ids: pa.Array, length: list[int], numbers: list[int]) -> pa.RecordBatch:
            key = np.array(numbers, np.int64)
            key += np.repeat(np.arange(len(length)), length) << 32
            key = key[(key & 0xFFFFFFFF) != 0xFFFFFFFF]
            key.sort()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            n, key = np.diff(np.r_[first, len(key)]), key[first]
            ends = pa.array(np.searchsorted(key, np.arange(len(length) + 1) << 32).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key & 0xFFFFFFFF, n))
            return pa.RecordBatch.from_arrays([ids, pa.array(length, pa.int32()), *lists], ["doc_id", "length", "terms", "counts"])

        for batch in batches:
            begin, length, numbers = 0, [], []
            for at, text in enumerate(batch.column("text"), 1):
                words = words_of(text.as_py())
                length.append(len(words))
                numbers.extend(map(get, words, repeat(-1)))
                if len(numbers) >= _WORDS or at == batch.num_rows:
                    yield packed(batch.column("doc_id").slice(begin, at - begin), length, numbers)
                    begin, length, numbers = at, [], []

    return run


def _numbered(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their words by number, ascending."""
        number = vocabulary.value
        for batch in batches:
            words, counts = batch.column("terms"), batch.column("counts")
            size = np.diff(words.offsets.to_numpy())
            key = np.array([number[w] for w in words.flatten().to_pylist()], np.int64) + (np.repeat(np.arange(len(size)), size) << 32)
            order = np.argsort(key)
            ends = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key[order] & 0xFFFFFFFF, counts.flatten().to_numpy()[order]))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), *lists], ["query_id", "terms", "counts"])

    return run


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(term, n) over the task's documents; term -1: documents, -2: words."""
        counts, total, docs = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            counts += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            total, docs = total + int(batch.column("length").to_numpy().sum()), docs + batch.num_rows
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, some].astype(np.int32)), pa.array(np.r_[docs, total, counts[some]].astype(np.int64))], ["term", "n"])

    return run


def answer(shards: list[Shard], asked: list, best: list[Best], dense: np.ndarray) -> int:
    """Bring the best of queries (id, terms, weights; some terms each) up to date with the shards of a part; returns how many postings were read."""
    if not asked:
        return 0
    bound = np.empty((len(shards), len(asked)))
    for at in range(0, len(asked), 1024):
        some = asked[at : at + 1024]
        size = np.array([len(own) for _, own, _ in some])
        terms, weights = (np.concatenate([q[x] for q in some]) for x in (1, 2))
        for row, shard in zip(bound, shards):
            row[at : at + 1024] = shard.bounds(np.cumsum(size) - size, terms, weights)
    first, read = bound.argmax(axis=0), 0
    for again in (False, True):
        for i, (shard, most) in enumerate(zip(shards, bound)):
            if again:
                floor = np.array([o.threshold for o in best]) * (1 - SLACK)
                own = np.flatnonzero((first != i) & (most > 0) & (most >= floor))
                own = own[np.argsort(first[own], kind="stable")]  # alike queries have few lists in a product
            else:
                own = np.flatnonzero((first == i) & (most > 0))
            for at in range(0, len(own), _QUERIES):
                some = own[at : at + _QUERIES]
                part = [asked[q] for q in some]
                read += evaluate_some(shard, part, [best[q] for q in some], dense, shard.long_sums(part))
    return read


def _search(queries, idf: np.ndarray, mean: float, k: int, k1: float, b: float, shard_docs: int, shard_postings: int, block_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, start, every, weight = queries.value
        asked = [(q, every[i:j], weight[i:j]) for q, i, j in zip(ids.tolist(), start[:-1].tolist(), start[1:].tolist())]
        best = [Best(k) for _ in asked]
        dense = np.zeros(len(idf))
        held: list[pa.RecordBatch] = []
        docs = postings = 0

        def finish() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, length = (table.column(x).to_numpy() for x in ("doc_id", "length"))
            terms, counts = (table.column(x).combine_chunks() for x in ("terms", "counts"))
            start = terms.offsets.to_numpy()
            size, start, terms, counts = np.diff(start), start[:-1] - start[0], terms.flatten().to_numpy(), counts.flatten().to_numpy()
            shards = []
            for own in alike(size, terms, counts):
                at = _spans(start[own], size[own])
                shards.append(Shard(ids[own], length[own], size[own], terms[at], counts[at], idf, mean, k1, b, block_docs))
            answer(shards, asked, best, dense)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                docs, postings = docs + part.num_rows, postings + len(part.column("terms").flatten())
                if docs >= shard_docs or postings >= shard_postings:
                    finish()
                    docs = postings = 0
        if held:
            finish()
        for at in range(0, len(asked), 512):
            part = [(q[0], o) for q, o in zip(asked[at : at + 512], best[at : at + 512])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for q, o in part for _ in o.ids], pa.int64()), pa.array(np.concatenate([o.ids for _, o in part])), pa.array(np.concatenate([o.scores for _, o in part]))],
                ["query_id", "doc_id", "score"],
            )

    return run


def _blocks(terms: DataFrame, total: int, most: int) -> int:
    """Into how many blocks queries of `total` words are dealt, for at most about so many different words in each."""
    blocks, limit = 1, -(-max(total, 1) // most)
    while blocks < limit:
        words = terms.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), F.explode("terms").alias("word")).distinct()
        if words.groupBy("block").count().agg(F.max("count")).first()[0] <= most:
            break
        blocks = min(2 * blocks, limit)
    return blocks


def search(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, shard_docs: int = 16_384, shard_postings: int = 6_000_000, block_docs: int = 64, max_terms: int = 1_000_000, task_docs: int = 250_000, pass_terms: int = 8_000_000) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best of docs (doc_id long, text) for each of queries (query_id long, text).

    Words are lower-cased runs of letters and digits; a word counts in a query
    as often as it occurs. Equal scores rank by doc_id. Documents that share no
    word with a query are never returned, so a null or empty query gives no
    row. Queries with a null id are left out, as are documents with one (they
    count in the statistics); of repeated rows each document counts, each query
    once. max_terms bounds the distinct words of all queries together, which a
    task holds; more of them go through the documents' texts once more for each
    block of queries. pass_terms bounds the sum of the distinct words of each query
    that a task holds; more go through the index once more. The documents of a part
    (of one shard or some) are shard_docs, or their postings shard_postings, at most
    (one document may have more); a task has about task_docs documents.
    """
    sc = docs.sparkSession.sparkContext
    asked = queries.where("query_id is not null").select("query_id", "text").distinct()
    terms = stage(asked.mapInArrow(_query_terms, "query_id long, terms array<string>, counts array<int>").where(F.size("terms") > 0), "queries")
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = _blocks(terms, total, max_terms)
    corpus = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        words = own.select(F.explode("terms").alias("word"), "query_id").groupBy("word").agg(F.min("query_id").alias("first")).toArrow()
        words = words.sort_by([("first", "ascending"), ("word", "ascending")]).column("word").to_pylist()
        vocabulary = dict(zip(words, range(len(words))))
        del words
        known = sc.broadcast(vocabulary)
        own = stage(own.mapInArrow(_numbered(known), "query_id long, terms array<int>, counts array<int>"), "numbered")
        index = stage(corpus.mapInArrow(_index(known), "doc_id long, length int, terms array<int>, counts array<int>"), "index")
        known.destroy()
        counted = index.select("length", "terms").mapInArrow(_count(len(vocabulary)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        term, n = (counted.column(x).to_numpy() for x in ("term", "n"))
        every, all_words = int(n[term == -1].sum()), int(n[term == -2].sum())
        df = np.zeros(len(vocabulary))
        df[term[term >= 0]] = n[term >= 0]
        idf = np.log(1 + (every - df + 0.5) / (df + 0.5))
        tasks = max(4 * sc.defaultParallelism, -(-every // task_docs))
        passes = -(-max(own.agg(F.sum(F.size("terms"))).first()[0] or 0, 1) // pass_terms)
        for turn in range(passes):
            some = own.where(F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(passes)) == turn).toArrow().sort_by("query_id").combine_chunks()
            lists, often = (some.column(x).combine_chunks() for x in ("terms", "counts"))
            start = lists.offsets.to_numpy()
            sent = sc.broadcast((some.column("query_id").to_numpy(), start - start[0], lists.flatten().to_numpy(), often.flatten().to_numpy()))
            found = index.where("doc_id is not null").coalesce(tasks).mapInArrow(_search(sent, idf, all_words / max(every, 1), k, k1, b, shard_docs, shard_postings, block_docs), "query_id long, doc_id long, score double")
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
            found = stage(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score"), "found")
            sent.destroy()
            out = found if out is None else out.unionByName(found)
    return out
