"""Language identification by word-first backoff.

A word known from the training rows scores by its log frequency in each
language. An unseen word falls back to its character n-grams, the longest
length first; the first length with a known n-gram decides. A text scores the
mean over its words, and the smallest mean wins.

Training counts run as Spark aggregations over a bounded, hashed sample of the
labelled rows; the model (at most `max_words` words and `max_grams` n-grams of
each language) goes to the tasks, which score whole texts in Arrow batches
without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

UNDETERMINED = "und"
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; a run without a letter (only numerals such as a superscript) is none."""
    if not text:
        return []
    found = _RUN.findall(text.lower())
    return found if "".join(found).isalpha() else [w for w in found if any(map(str.isalpha, w))]


def grams_of(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Costs:
    """Costs of words or n-grams, kept for the languages that have them; others have the row's penalty.

    Entries start[i] to start[i + 1] are row i's: the language's number, and
    the cost less the penalty.
    """

    index: dict[str, int]
    start: np.ndarray
    lang: np.ndarray
    less: np.ndarray
    penalty: np.ndarray

    def total(self, rows: list[int], shares: np.ndarray, langs: int) -> np.ndarray:
        """The rows' costs in each language, each times its share."""
        at = np.array(rows, np.int64)
        first, n = self.start[at], self.start[at + 1] - self.start[at]
        ends = np.cumsum(n)
        entry = np.repeat(first - ends + n, n) + np.arange(ends[-1])
        return self.penalty[at] @ shares + np.bincount(self.lang[entry], self.less[entry] * np.repeat(shares, n), langs)


@dataclass
class LanguageModel:
    """Costs are negative natural log frequencies; a word or n-gram that a language lacks costs a penalty, the same in all languages."""

    langs: list[str]
    prior: np.ndarray
    words: Costs
    grams: Costs
    max_n: int

    def grams_known(self, word: str) -> list[int]:
        """Numbers of the word's longest n-grams of which any is known."""
        get = self.grams.index.get
        for n in range(self.max_n, 0, -1):
            found = [i for g in grams_of(word, n) if (i := get(g)) is not None]
            if found:
                return found
        return []


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.update((lang, w) for w in words_of(text))
        yield pa.RecordBatch.from_pydict(
            {"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())},
            schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]),
        )


def _count_grams(max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, word, k in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                for n in range(1, max_n + 1):
                    for g in grams_of(word, n):
                        counts[lang, g] += k
            yield pa.RecordBatch.from_pydict(
                {"lang": [k[0] for k in counts], "gram": [k[1] for k in counts], "n": list(counts.values())},
                schema=pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]),
            )

    return run


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (lang, n, ...) that are among their language's `most` most frequent; of equal ones that would go beyond, none.

    From a histogram of n for each language, so that no task sorts a language.
    """
    cuts, seen = {}, {}
    for r in sorted(counts.groupBy("lang", "n").count().collect(), key=lambda r: -r["n"]):
        seen[r["lang"]] = seen.get(r["lang"], 0) + r["count"]
        if seen[r["lang"]] <= most:
            cuts[r["lang"]] = r["n"]
    if not cuts:
        return counts.where("false")
    least = F.broadcast(counts.sparkSession.createDataFrame(list(cuts.items()), "lang string, least long"))  # a row for each language
    return counts.join(least, "lang").where("n >= least").drop("least")


def _costs(table: pa.Table, key: str, langs: list[str], share_of) -> Costs:
    """table: (lang, key, n); share_of(key, lang): of how many the n are a share."""
    at = {x: i for i, x in enumerate(langs)}
    keys, names, counts = (table.column(c).to_pylist() for c in (key, "lang", "n"))
    index: dict[str, int] = {}
    row = np.array([index.setdefault(k, len(index)) for k in keys], np.int64)
    of = np.array([share_of(k, x) for k, x in zip(keys, names)], float)
    lang = np.array([at[x] for x in names], np.int32)
    penalty = np.zeros(len(index))
    worst = {n: math.log(max(max((share_of("x" * n, x) for x in langs), default=1), 1)) + 1.0 for n in {len(k) for k in index}}
    for k, i in index.items():
        penalty[i] = worst[len(k)]
    order = np.lexsort((lang, row))
    start = np.searchsorted(row[order], np.arange(len(index) + 1))
    return Costs(index, start, lang[order], (-np.log(np.array(counts, float) / of) - penalty[row])[order], penalty)


def fit(labelled: DataFrame, max_rows: int = 20_000, max_words: int = 40_000, max_grams: int = 30_000, max_n: int = 5) -> LanguageModel | None:
    """Learn from the rows of (doc_id, text, lang) whose lang is known; None if there are none.

    max_rows bounds the labelled rows that are used, max_words and max_grams
    the most frequent words and n-grams that the model keeps for each language,
    whatever the others have. Null texts count as empty.
    """
    rows = bounded_sample(labelled.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text"), F.col("doc_id"), max_rows)
    counts = rows.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    try:
        totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
        langs = sorted(totals)
        if not langs:
            return None
        words = _costs(_most_frequent(counts, max_words).toArrow(), "word", langs, lambda _, x: totals[x])
        grams = counts.mapInArrow(_count_grams(max_n), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
        of_length = {(r[0], r[1]): r[2] for r in grams.groupBy("lang", F.length("gram")).agg(F.sum("n")).collect()}
        parts = _costs(_most_frequent(grams, max_grams).toArrow(), "gram", langs, lambda g, x: of_length.get((x, len(g)), 0))
        grams.unpersist()
    finally:
        counts.unpersist()
    prior = np.array([totals[x] for x in langs], dtype=float)
    return LanguageModel(langs, prior / prior.sum(), words, parts, max_n)


def score_texts(model: LanguageModel | None, texts: list[str | None], cache: dict[str, list[int]], sharpness: float = 8.0) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for text in texts:
        words = words_of(text)
        if not words or model is None:
            langs.append(UNDETERMINED)
            scores.append(0.0)
            continue
        at = [model.words.index.get(w, -1) for w in words]
        known = [i for i in at if i >= 0]
        n, size = len(known), len(model.langs)
        total = model.words.total(known, np.ones(n), size) if known else np.zeros(size)
        grams: list[int] = []
        shares: list[float] = []
        if n < len(words):
            for w, k in Counter(w for w, i in zip(words, at) if i < 0).items():
                if (found := cache.get(w)) is None:
                    if len(cache) >= 50_000:
                        cache.clear()
                    found = cache[w] = model.grams_known(w)
                if found:
                    grams += found
                    shares += [k / len(found)] * len(found)
                    n += k
            total = total + model.grams.total(grams, np.array(shares), size) if grams else total
        mean = total / n if n else -np.log(model.prior)
        p = np.exp(-(mean - mean.min()) * min(n or 1, sharpness))
        best = min(range(len(model.langs)), key=lambda i: (mean[i], -model.prior[i], i))
        langs.append(model.langs[best])
        scores.append(float(p[best] / p.sum()))
    return langs, scores


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs (doc_id, text), repeated rows included.

    lang_pred is a language of the model; `und` with score 0 where text is null
    or has no letter, or where the model is None because nothing could be
    learned. Equal costs go to the language with more training words, then to
    the first by name. score is the winner's share of exp(-8 x mean cost).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in batches:
            langs, scores = score_texts(model, batch.column("text").to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel | None, min_score: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose language is identified with at least min_score."""
    names = docs.columns
    kinds = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in batches:
            langs, scores = score_texts(model, batch.column(names.index("text")).to_pylist(), cache)
            yield batch.filter(pa.array([x != UNDETERMINED and s >= min_score for x, s in zip(langs, scores)]))

    return docs.mapInArrow(run, kinds)


def held_out(doc_id: Column, folds: int = 4, rest: int = 2) -> Column:
    """Whether the row is kept from training; false for a null id, which is not learned from either."""
    from .common import fold_of

    return F.coalesce(fold_of(doc_id, folds) == rest, F.lit(False))
