"""Quality scores: ridge regression on random Fourier features, calibrated.

Each document becomes a short vector of statistics of its text (shares of kinds
of characters, word and line lengths, repetition). Standardised, the vector is
mapped to cosines at random frequencies, whose inner products approximate a
Gaussian kernel. The normal equations of a ridge regression are summed within
each partition, then over groups of partitions and groups of these, so a task sums
about the root of their number and the driver gets a fixed number of matrices however
large the corpus is. Scores are calibrated by isotonic regression on counts in fixed
bins, which are summed the same way; the labelled rows are dealt to two halves at
random by their place for that, so repeated texts lie in both, and each half is
scored by the equations of the other. Where a half has fewer than ``LEAST_OF_LABEL``
rows of a label, the equations of all rows score both.

All labelled rows for which ``learn`` holds are used. Without any label every
score is 0.5; with labels of one kind only, every score is that label.

Null and empty texts have statistics too (zeros) and so get a score. Repeated
rows get equal scores; a repeated label row counts as often as it comes, also where
label rows of one id contradict each other; null labels are not used. An empty table gives an empty result. Only the columns
named are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, settled
from .text_kernel import gram_hashes, sliced, span_hashes, utf8, words

STATISTICS = (
    "log_bytes", "log_words", "upper", "lower", "digit", "space", "newline", "high", "punctuation", "marks", "pipes",
    "stop", "word_mean", "word_sd", "distinct_words", "same_as_last", "same_pair", "longest_word", "words_a_line", "upper_words", "closed_words", "distinct_pairs",
)
GROUPS, BINS, LOW, HIGH = 8, 512, -0.5, 1.5
LEAST_OF_LABEL = 8


def _classes() -> np.ndarray:
    t = np.zeros((8, 256), bool)
    t[0, 65:91] = t[1, 97:123] = t[2, 48:58] = True
    t[3, [32, 9]] = t[4, [10, 13]] = True
    t[5, 128:] = True
    for c in range(33, 127):
        t[6, c] = not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123)
    t[7, [ord(c) for c in "!#$%&*@^~_=+<>\\{}[]"]] = True
    return t


_CLASS = _classes()


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    raw, offsets = utf8(texts)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    least = np.maximum(size, 1)
    out = np.zeros((n, len(STATISTICS)))
    out[:, 0] = np.log1p(size)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    counts = [per_doc(_CLASS[i][raw]) for i in range(8)]
    for i, at in ((0, 2), (1, 3), (2, 4), (3, 5), (4, 6), (5, 7), (6, 8), (7, 9)):
        out[:, at] = counts[i] / least
    out[:, 10] = per_doc(raw == 124) / least
    out[:, 11] = per_doc(raw == 46) / least
    starts, ends, docs = words(raw, offsets)
    if not len(starts):
        return out
    n_words = np.bincount(docs, minlength=n).astype(float)
    each = np.maximum(n_words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(docs, length, n) / each
    out[:, 1] = np.log1p(n_words)
    out[:, 12] = mean
    out[:, 13] = np.sqrt(np.maximum(np.bincount(docs, length * length, n) / each - mean * mean, 0))
    h = span_hashes(raw, starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (docs[1:] == docs[:-1])
    out[:, 15] = np.bincount(docs, same, n) / each
    lag = np.zeros(len(h), bool)
    lag[2:] = (h[2:] == h[:-2]) & (docs[2:] == docs[:-2])
    out[:, 16] = np.bincount(docs, lag, n) / each
    np.maximum.at(out[:, 17], docs, np.log1p(length))
    out[:, 18] = np.log1p(n_words / (counts[4] + 1))
    first, last = raw[starts], raw[ends - 1]
    out[:, 19] = np.bincount(docs, _CLASS[0][first] & (_CLASS[0][last] | _CLASS[6][last]), n) / each
    out[:, 20] = np.bincount(docs, _CLASS[6][last], n) / each

    def distinct(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of))
        v, d = values[order], of[order]
        fresh = np.ones(len(v), bool)
        fresh[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        return np.bincount(d[fresh], minlength=n).astype(float)

    out[:, 14] = distinct(h, docs) / each
    pairs, valid = gram_hashes(h, docs, 2)
    out[:, 21] = distinct(pairs[valid], docs[valid]) / np.maximum(n_words - 1, 1)
    return out


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its statistics as an array."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", 1 << 20):
                x = statistics(batch.column(1))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None
    steps: np.ndarray | None  # calibrated value of each bin
    constant: float = 0.5

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.constant)
        place = (np.clip(self.raw(x), LOW, HIGH) - LOW) / (HIGH - LOW) * BINS - 0.5
        return np.clip(np.interp(place, np.arange(BINS), self.steps), 0, 1)


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = batch.column(0)
    x = np.asarray(flat.flatten()).reshape(len(flat), -1) if len(flat) else np.zeros((0, len(STATISTICS)))
    return x, np.asarray(batch.column(1)).astype(float), np.asarray(batch.column(2)).astype(int)


def _summed(rows: DataFrame, of, length: int) -> np.ndarray | None:
    """The sum over all rows of the vectors that ``of(x, y, half)`` makes of batches: by partition, then by GROUPS of partitions."""

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(length)
        n = 0
        for b in batches:
            x, y, half = _matrix(b)
            if len(x):
                total += of(x, y, half)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "v"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, g = np.zeros(length), 0, 0
        for b in batches:
            for g, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total += np.frombuffer(v)
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "v"])

    parts = rows.rdd.getNumPartitions()
    wide = max(GROUPS, math.isqrt(parts))
    sums = rows.mapInArrow(lean(part), "g int, v binary")
    if parts > wide:
        sums = sums.withColumn("g", F.col("g") % wide).repartition(wide, "g").mapInArrow(lean(join), "g int, v binary")
    found = sums.withColumn("g", F.col("g") % GROUPS).repartition(GROUPS, "g").mapInArrow(lean(join), "g int, v binary").collect()  # GROUPS rows at most
    return np.sum([np.frombuffer(r["v"]) for r in found], axis=0) if found else None


def isotonic(weight: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing rates of the bins by pooling adjacent violators; empty bins take the line between their neighbours."""
    at = np.flatnonzero(weight > 0)
    blocks: list[list[float]] = []  # sum, weight, bins
    for i in at:
        blocks.append([positive[i], weight[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, k = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][2] += k
    values = np.concatenate([np.full(int(k), s / w) for s, w, k in blocks])
    return np.interp(np.arange(len(weight)), at, values)


def fit(rows: DataFrame, waves: int = 256, width: float = 4.0, ridge: float = 3.0, seed: int = 7) -> Model:
    """From rows (x, y, half): statistics, a label of 0 or 1, and 0 or 1 at random."""
    k = len(STATISTICS)
    sums = _summed(rows, lambda x, y, half: np.concatenate([[len(x), y.sum()], np.bincount(2 * half + y.astype(int), minlength=4), x.sum(0), (x * x).sum(0)]), 6 + 2 * k)
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(k), np.ones(k), rng.standard_normal((k, waves)) / width, rng.uniform(0, 2 * np.pi, waves), None, None)
    if sums is None:
        return model
    n, positive = sums[:2]
    if positive in (0, n):
        model.constant = float(positive > 0)
        return model
    model.mean = sums[6 : 6 + k] / n
    model.scale = np.sqrt(np.maximum(sums[6 + k :] / n - model.mean**2, 1e-9)) + 1e-3
    size = waves + k + 1

    def equations(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([v for h in (0, 1) for m in [half == h] for v in ((z[m].T @ z[m]).ravel(), z[m].T @ y[m])])

    both = _summed(rows, equations, 2 * (size * size + size)).reshape(2, -1)
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6

    def solved(sums: np.ndarray) -> np.ndarray:
        return np.linalg.solve(sums[: size * size].reshape(size, size) + np.diag(penalty), sums[size * size :])

    model.weights = solved(both.sum(0))
    apart = sums[2:6].min() >= LEAST_OF_LABEL
    others = np.stack([solved(both[1]), solved(both[0])] if apart else [model.weights] * 2, 1)  # for the rows of half 0 and 1

    def binned(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> np.ndarray:
        raw = (model.features(x) @ others)[np.arange(len(x)), half]
        b = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(b, minlength=BINS), np.bincount(b, y, BINS)])

    counts = _summed(rows, binned, 2 * BINS)
    model.steps = isotonic(counts[:BINS], counts[BINS:])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of rows (doc_id, x)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(-1, len(STATISTICS))
            if len(x):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(lean(run), "doc_id long, score double")


def _labelled(stats: DataFrame, labels: DataFrame, learn, id_col: str, label_col: str) -> Model:
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & learn(F.col("doc_id")))
    half = (F.xxhash64(F.monotonically_increasing_id()) % 2 != 0).cast("int").alias("half")  # written, so it stays as it is
    return fit(settled(stats.join(known, "doc_id").select("x", "y", half), "quality-labelled"))


def learnt(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model from the labels of the ids for which ``learn`` (of a column) holds."""
    return _labelled(settled(with_statistics(docs, id_col, text_col), "quality-statistics"), labels, learn, id_col, label_col)


def quality_scores(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id and score of every document, learnt as in ``learnt``."""
    stats = settled(with_statistics(docs, id_col, text_col), "quality-statistics")
    return score(stats, _labelled(stats, labels, learn, id_col, label_col))
