"""Toxicity by the nearest labelled examples.

A bounded sample of labelled texts becomes an inverted index of TF-IDF vectors over
all their terms. The examples are put in an order in which those with the same
strongest term are neighbours, and cut into blocks; a term's postings lie by block,
and for each block the index knows the term's largest weight in it. A text's nearest
examples by cosine are found exactly: the bound of a block is the sum over the text's
terms of query weight times block maximum, blocks are visited from the highest bound
down, and postings of a block are read only if its bound beats the k-th best cosine
so far. The examples found vote with the square of their cosine; the share of toxic
votes and the best cosine are turned into a probability by counts on the examples
themselves, each left out of its own vote. The examples found are the evidence for a
score.

A term is a letter run, and none that an example has is left out, neither of the
examples nor of the texts that are scored. A term's weight is 1 + log of its count,
times its idf, times the square of the correlation of term and label on the sample:
topics would decide who is near otherwise (README has the figures).

The sample may hold the labels in another mix than the corpus. So an example
counts as many times as its label has learnable labels for each example of it
(in units that sum to the sample's size) in all that is fitted: document
frequencies, correlations, and the counts that turn votes into scores.

Bounds: ``EXAMPLES_EACH`` examples of each label, chosen by a hash of their
ids; the driver gets their counted terms, not their texts. What is scored is always
the whole text.

An id whose label rows contradict each other has the label that most of them have,
or 1 if there is no such; of several texts with one id one serves as the example.
Null and empty texts get the rate of examples without terms. Without labels
every score is 0.5. Ties in cosine go to the example with the smaller id.
Repeated rows get equal scores; an empty table gives an empty result. Only the
columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .quality import isotonic
from .text_kernel import ascii_lower, sliced, span_hashes, utf8, words

EXAMPLES_EACH, NEIGHBOURS, BLOCK = 1500, 12, 8
SCHEMA = "doc_id long, score double, evidence array<long>"

Bag = tuple[np.ndarray, np.ndarray]  # hashes of terms, sorted, and how often each comes

_GAP = np.ones(256, bool)
_GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash of the word, document) of every letter run, and the number of texts."""
    raw, offsets = utf8(texts)
    raw = ascii_lower(raw)
    starts, ends, docs = words(raw, offsets, _GAP)
    return span_hashes(raw, starts, ends), docs, len(offsets) - 1


def counted(h: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) pairs in that order, with counts."""
    order = np.lexsort((h, docs))
    h, docs = h[order], docs[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(fresh)
    return docs[at], h[at], np.diff([*at, len(h)])


def bags(texts: pa.Array) -> list[Bag]:
    """The counted terms of each text."""
    h, docs, n = terms(texts)
    d, t, count = counted(h, docs)
    cut = np.searchsorted(d, np.arange(n + 1))
    return [(t[a:b], count[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one after the other."""
    size = end - start
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


@dataclass
class Index:
    """``vocabulary``: sorted term hashes. Term t has entries ``first[t]:first[t + 1]``, one a block that holds it: ``block``, ``peak`` (its largest weight there) and postings ``begin[entry]:begin[entry + 1]`` with ``weight``."""

    vocabulary: np.ndarray
    factor: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    peak: np.ndarray = field(default_factory=lambda: np.zeros(0))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    posting: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    no_term: float = 0.5
    cells: np.ndarray = field(default_factory=lambda: np.full((8, 4), 0.5))
    read: int = 0  # postings that searches have read

    def vector(self, bag: Bag) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, weights) of a text's unit vector; no terms if all have weight 0."""
        t, n = bag
        if not len(self.vocabulary) or not len(t):
            return np.zeros(0, np.int64), np.zeros(0)
        place = np.minimum(np.searchsorted(self.vocabulary, t), len(self.vocabulary) - 1)
        hit = self.vocabulary[place] == t
        place = place[hit]
        w = (1 + np.log(n[hit])) * self.factor[place]
        place, w = place[w > 0], w[w > 0]
        return place, w / np.sqrt(w @ w) if len(w) else w

    def fill(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Make the postings of the examples' vectors, in their order."""
        d = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
        t, w = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        order = np.lexsort((d, t))
        t, self.posting, self.weight = t[order], d[order], w[order]
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (self.posting[1:] // BLOCK != self.posting[:-1] // BLOCK)
        at = np.flatnonzero(fresh)
        self.begin = np.concatenate((at, [len(t)]))
        self.block = self.posting[at] // BLOCK
        self.peak = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0)
        self.first = np.searchsorted(t[at], np.arange(len(self.vocabulary) + 1))

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine with the vector, exactly, and the cosines; only those above 0."""
        entry, weight = ranges(self.first[t], self.first[t + 1]), np.repeat(w, self.first[t + 1] - self.first[t])
        of = self.block[entry]
        bound = np.bincount(of, weight * self.peak[entry])
        order = np.argsort(-bound, kind="stable")
        best_i, best_c = np.zeros(0, np.int64), np.zeros(0)
        i, step = 0, 8
        while i < len(order):
            blocks, i = order[i : i + step], i + step
            blocks = blocks[bound[blocks] > (best_c[-1] - 1e-9 if len(best_c) >= k else 0)]
            if not len(blocks):
                break
            chosen = np.zeros(len(bound), bool)
            chosen[blocks] = True
            inside = chosen[of]
            some = entry[inside]
            lo, hi = self.begin[some], self.begin[some + 1]
            at = ranges(lo, hi)
            self.read += len(at)
            cos = np.bincount(self.posting[at], self.weight[at] * np.repeat(weight[inside], hi - lo), len(self.ids))
            if without >= 0:
                cos[without] = 0
            found = np.flatnonzero(cos > (best_c[-1] - 1e-9 if len(best_c) >= k else 0))
            best_i, best_c = np.concatenate([best_i, found]), np.concatenate([best_c, cos[found]])
            top = np.lexsort((self.ids[best_i], -np.round(best_c, 9)))[:k]
            best_i, best_c = best_i[top], best_c[top]
            step *= 4
        return best_i, best_c

    def cell(self, i: np.ndarray, c: np.ndarray) -> tuple[int, int]:
        vote = float((c * c) @ self.toxic[i] / (c @ c))
        return min(7, int(vote * 8)), min(3, int(c[0] * 4))

    def score(self, t: np.ndarray, w: np.ndarray) -> tuple[float, list[int]]:
        if not len(t):
            return self.no_term, []
        i, c = self.nearest(t, w)
        return (float(self.cells[self.cell(i, c)]), self.ids[i].tolist()) if len(i) else (self.no_term, [])


def association(df: np.ndarray, both: np.ndarray, pos: float, n: float) -> np.ndarray:
    """The square of each term's correlation with the label: chi-square over n."""
    expected = df * pos / n
    spread = expected * (1 - pos / n) * (1 - df / n)
    return np.where(spread > 1e-9, (both - expected) ** 2 / np.maximum(spread, 1e-9), 0) / n


def build(ids: list[int], found: list[Bag | str | None], labels: list[int], counts: dict[int, int] | None = None) -> Index:
    """The index of the examples (counted terms, or texts), with its calibration; ``counts``: how many learnable labels of each kind there are (as in the sample, if not given)."""
    n = len(ids)
    if not n:
        none = np.zeros(0)
        return Index(np.zeros(0, np.uint64), none, none, np.zeros(0, np.int64), none)
    found = [x if isinstance(x, tuple) else bags(pa.array([x], pa.string()))[0] for x in found]
    y = np.array(labels, float)
    sampled = np.array([(y == k).sum() for k in (0, 1)], float)
    whole = sampled if counts is None else np.array([counts.get(k, 0) for k in (0, 1)], float) * (sampled > 0)
    worth = whole / np.maximum(sampled, 1) * n / whole.sum()  # of an example of each label; 1 where the mix is the corpus's
    each = worth[y.astype(int)]
    d = np.repeat(np.arange(n), [len(t) for t, _ in found])
    vocabulary, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *[t for t, _ in found]]), return_inverse=True)
    df = np.bincount(at, each[d], len(vocabulary))
    pos = each @ y
    idf = np.log(1 + n / df)
    both = np.bincount(at, (each * y)[d], len(vocabulary))
    factor = idf * association(df, both, pos, n) if 0 < pos < n else idf
    index = Index(vocabulary, factor, idf, np.array(ids, np.int64), y)
    rows = [index.vector(x) for x in found]
    strongest = np.array([t[np.argmax(w)] if len(t) else -1 for t, w in rows])
    order = np.lexsort((ids, [-w.max(initial=0) for _, w in rows], strongest))
    rows, each = [rows[i] for i in order], each[order]
    index.ids, index.toxic = index.ids[order], y[order]
    index.fill(rows)
    vote = (np.arange(8) + 0.5) / 8
    vote = vote * worth[1] / (vote * worth[1] + (1 - vote) * worth[0])
    hits, toxic = np.full((8, 4), 1.0), np.tile(vote[:, None], (1, 4))  # one example's worth of the plain vote
    rest = [0.0, 0.0]
    for i, (t, w) in enumerate(rows):
        near, c = index.nearest(t, w, without=i) if len(t) else ([], None)
        if len(near):
            x = index.cell(near, c)
            hits[x] += each[i]
            toxic[x] += each[i] * index.toxic[i]
        else:
            rest[0] += each[i]
            rest[1] += each[i] * index.toxic[i]
    index.cells = np.stack([isotonic(hits[:, c], toxic[:, c]) for c in range(4)], 1)  # more toxic votes never lower a score
    index.no_term = (rest[1] + pos / n) / (rest[0] + 1)
    index.read = 0
    return index


def examples(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", each: int = EXAMPLES_EACH) -> tuple[list, list, list, dict[int, int]]:
    """Ids, counted terms and labels of the bounded sample, and how many learnable ids of each label there are."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & learn(F.col("doc_id")))
    known = rows.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], [], [], {}
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, float(min(1.0, 1.2 * each / n)))])
    chosen = known.filter(lot < F.element_at(share, F.col("y")) * F.lit(1 << 20))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text"):
                found = bags(batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.tobytes() for t, _ in found], pa.binary()), pa.array([n.astype("<i8").tobytes() for _, n in found], pa.binary())], ["doc_id", "y", "t", "n"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small = F.broadcast(chosen)  # both labels: 2.4 * each rows or so
    one = texts.join(small, "doc_id").select("doc_id", "y", "text").mapInArrow(lean(count), "doc_id long, y int, t binary, n binary").groupBy("doc_id", "y").agg(F.min(F.struct("t", "n")).alias("x"))
    found = sorted(one.select("doc_id", "y", "x.t", "x.n").collect(), key=lambda r: r["doc_id"])  # a row an id
    found = [r for y in (0, 1) for r in [r for r in found if r["y"] == y][:each]]
    return [r["doc_id"] for r in found], [(np.frombuffer(r["t"], np.uint64), np.frombuffer(r["n"], "<i8")) for r in found], [r["y"] for r in found], counts


def toxicity_scores(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and the ids of the nearest examples of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # EXAMPLES_EACH texts' terms of each label

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for batch in sliced(whole, "text"):
                scores, evidence = zip(*[index.score(*index.vector(x)) for x in bags(batch.column(1))], strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)
