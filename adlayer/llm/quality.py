"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pair
term is half of the squared sum less the sum of squares in each of the few
dimensions of v, so a text is scored in time linear in its words.

Features of whole texts are made in the tasks, for training and scoring alike.
Training takes a bounded sample of the labelled rows (AdaGrad in small batches
over their sparse features); scoring sends the parameters to the tasks.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

WORD_BUCKETS = 1 << 14
LEVELS = 12
_UPPER, _DIGIT, _MARK = (re.compile(p) for p in ("[" + "".join(filter(str.isupper, map(chr, range(0x10000)))) + "]", r"[0-9]", r"[^\w\s]"))
#: Structure statistics and metadata, each cut into LEVELS levels between two values.
STATISTICS = {
    "log_words": (0.0, 10.0), "word_length": (0.0, 16.0), "upper": (0.0, 1.0), "digits": (0.0, 0.5), "marks": (0.0, 0.5), "distinct": (0.0, 1.0),
    "top_word": (0.0, 0.6), "same_next": (0.0, 0.6), "line_words": (0.0, 60.0), "same_lines": (0.0, 1.0), "short_words": (0.0, 0.8), "no_letter": (0.0, 0.6), "marked_words": (0.0, 1.0), "log_chars": (0.0, 12.0),
}
N_FEATURES = WORD_BUCKETS + LEVELS * len(STATISTICS)


def statistics(text: str, words: list[str], counts: Counter, n_chars: int | None) -> dict[str, float]:
    n, size = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "log_words": math.log1p(len(words)),
        "word_length": size / n,
        "upper": len(_UPPER.findall(text)) / size,
        "digits": len(_DIGIT.findall(text)) / size,
        "marks": len(_MARK.findall(text)) / size,
        "distinct": len(counts) / n,
        "top_word": max(counts.values(), default=0) / n,
        "same_next": sum(map(str.__eq__, words, words[1:])) / n,
        "line_words": n / max(len(lines), 1),
        "same_lines": 1 - len(set(lines)) / max(len(lines), 1),
        "short_words": sum(k for w, k in counts.items() if len(w) <= 3) / n,
        "no_letter": sum(k for w, k in counts.items() if not any(map(str.isalpha, w))) / n,
        "marked_words": sum(k for w, k in counts.items() if not w[-1].isalnum()) / n,
        "log_chars": math.log1p(max(n_chars or 0, 0)),
    }


def features(text: str | None, n_chars: int | None, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and their values. Words share a unit vector by root counts; each statistic has one level."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    buckets: dict[int, float] = {}
    for w, k in counts.items():
        if (h := cache.get(w)) is None:
            if len(cache) >= 200_000:
                cache.clear()
            h = cache[w] = zlib.crc32(w.encode("utf-8", "replace")) % WORD_BUCKETS
        buckets[h] = buckets.get(h, 0.0) + math.sqrt(k)
    norm = math.sqrt(sum(v * v for v in buckets.values())) or 1.0
    at, value = list(buckets), [v / norm for v in buckets.values()]
    for i, (name, x) in enumerate(statistics(text, words, counts, n_chars).items()):
        low, high = STATISTICS[name]
        level = min(LEVELS - 1, max(0, int((x - low) / (high - low) * LEVELS)))
        at.append(WORD_BUCKETS + i * LEVELS + level)
        value.append(0.5)
    return np.array(at, dtype=np.int32), np.array(value, dtype=np.float32)


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid; row r has the features from starts[r] on."""
        xv = self.factors[at] * value[:, None]
        pairs = (np.add.reduceat(xv, starts) ** 2 - np.add.reduceat(xv * xv, starts)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[at] * value, starts) + 0.5 * pairs


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 4, epochs: int = 6, batch: int = 128, rate: float = 0.15, decay: float = 1e-4, seed: int = 3) -> FactorisationMachine:
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    fm = FactorisationMachine(math.log(share / (1 - share)), np.zeros(N_FEATURES), rng.normal(0, 0.05, (N_FEATURES, rank)))
    g_bias, g_linear, g_factors = 1e-6, np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, rank), 1e-6)
    if len(set(labels.tolist())) < 2:
        return FactorisationMachine(math.log(share / (1 - share)), fm.linear, np.zeros_like(fm.factors))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), batch):
            part = order[s : s + batch]
            at = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part]).astype(float)
            size = np.array([len(rows[i][0]) for i in part])
            starts = np.r_[0, np.cumsum(size)[:-1]]
            off = (_sigmoid(fm.raw(at, value, starts)) - labels[part]) / len(part)
            each = np.repeat(off, size)
            sums = np.repeat(np.add.reduceat(fm.factors[at] * value[:, None], starts), size, axis=0)
            grad = (each * value)[:, None] * (sums - fm.factors[at] * value[:, None])
            own, back = np.unique(at, return_inverse=True)
            gl = np.bincount(back, each * value) + decay * fm.linear[own]
            gf = np.stack([np.bincount(back, grad[:, f]) for f in range(rank)], axis=1) + decay * fm.factors[own]
            g_linear[own] += gl**2
            g_factors[own] += gf**2
            g_bias += off.sum() ** 2
            fm.linear[own] -= rate * gl / np.sqrt(g_linear[own])
            fm.factors[own] -= 0.3 * rate * gf / np.sqrt(g_factors[own])
            fm.bias -= rate * off.sum() / math.sqrt(g_bias)
    return fm


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    for batch in batches:
        made = [features(t, n, cache) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], ["label", "at", "value"])


def _sized(docs: DataFrame) -> DataFrame:
    return docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.lit(None).cast("long"))


def fit(labelled: DataFrame, max_rows: int = 8000) -> FactorisationMachine:
    """Learn from rows of (doc_id, text, n_chars, label 0 or 1); rows with another label are left out.

    max_rows bounds the rows that are used. With one label or none the score
    is that label's smoothed share for every text.
    """
    rows = bounded_sample(_sized(labelled).where("label in (0, 1)").select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"), F.col("label").cast("int").alias("label")), F.col("doc_id"), max_rows)
    made = rows.select("label", "text", "n_chars").mapInArrow(_features, "label int, at binary, value binary").collect()
    made.sort(key=lambda r: (bytes(r["at"]), bytes(r["value"]), r["label"]))  # one order, whatever the partitions
    return train([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in made], np.array([r["label"] for r in made], dtype=float))


def score(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for each row of docs (doc_id, text, n_chars if there), repeated rows included.

    score: how likely label 1 is, 0 to 1; null and empty texts are scored by
    their statistics. predicted: 1 from threshold on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            made = [features(t, n, cache) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())]
            out = np.zeros(len(made))
            for s in range(0, len(made), 512):
                part = made[s : s + 512]
                starts = np.r_[0, np.cumsum([len(a) for a, _ in part])[:-1]]
                out[s : s + 512] = _sigmoid(model.raw(np.concatenate([a for a, _ in part]), np.concatenate([v for _, v in part]).astype(float), starts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return _sized(docs).select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
