"""Removal of word passages that occur earlier in the corpus, by difference-cover anchors.

A window of ``WINDOW`` words is removed if the same words start earlier, in the
order of (document id, place). Not every window is compared: a difference cover
of the residues modulo ``PERIOD`` holds, for every distance of two places, two
residues with that distance. So two equal windows, wherever they start, have an
anchor at equal distance from their starts: a gram of
``WINDOW - PERIOD + 1`` words at a cover position in both. Only such grams (4 in
13 places) are hashed and gathered; those that occur once are done with.
Around the others the match is extended to whole windows, and these are compared
by 128 bits of hash over 64-bit word hashes (96 of them are kept).

Documents are dealt to blocks by a hash of their place in their file, so no id
makes a large one. A block drops its own
repetitions first and sends each bucket of hash values one packed row, so a
passage that a third of all documents share costs a bucket one entry a block,
not one a document. A bucket answers each block with one bit an entry: whether
the anchor is shared, or whether the block holds a window's first occurrence.
The three readings of the documents share one exchange.

Null text has no words. Null ids come before all others; rows with the same id
are ordered by block, then by text, so one of several copies keeps its words. Documents shorter than the
window lose nothing. An empty table gives an empty result. Only the columns
named are read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_group, located, pieces
from .text_kernel import U, gram_hashes, span_hashes, utf8, words

WINDOW, PERIOD = 20, 13
#: A difference cover of the residues modulo 13 (every residue is a difference of two of them).
COVER = (0, 1, 3, 9)
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20
NO_ID = -(1 << 63)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def planes(values: np.ndarray) -> bytes:
    """The values' bytes, plane by plane: those of sorted values compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def bucket_cuts(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the sorted hashes of each bucket start: buckets are equal ranges of hash values."""
    return np.searchsorted((sorted_hashes >> U(32)) * U(buckets) >> U(32), np.arange(buckets + 1, dtype=U))


class Block:
    """The documents of a block in order, and their words."""

    def __init__(self, table: pa.Table) -> None:
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
        table = table.take(order)
        self.ids = table.column("doc_id")
        self.raw, self.offsets = utf8(table.column("text"))
        starts, ends, self.docs = words(self.raw, self.offsets)
        self.hashes = span_hashes(self.raw, starts, ends)
        n = len(self.offsets) - 1
        self.n_words = np.bincount(self.docs, minlength=n)
        self.place = np.arange(len(self.docs)) - (np.cumsum(self.n_words) - self.n_words)[self.docs]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct hashes, each anchor's place among them, how often each occurs here, each anchor's word)."""
        grams, valid = gram_hashes(self.hashes, self.docs, WINDOW - PERIOD + 1)
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        at = np.flatnonzero(valid & cover[self.place % PERIOD] & (self.n_words[self.docs] >= WINDOW))
        return *np.unique(grams[at], return_inverse=True, return_counts=True), at

    def windows(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows around shared anchors: (words they start at, group of each among the distinct ones, and the distinct ones' two hashes, sorted)."""
        _, inverse, counts, at = self.anchors()
        n = len(self.docs)
        shared = np.zeros(n + PERIOD + 1, np.int64)
        shared[1 + at[flags[inverse] | (counts[inverse] > 1)]] = 1
        shared = np.cumsum(shared)
        one, valid = gram_hashes(self.hashes, self.docs, WINDOW)
        start = np.flatnonzero(valid & (shared[PERIOD : PERIOD + n] > shared[:n]))
        two, _ = gram_hashes(self.hashes, self.docs, WINDOW, 1)
        a, b = one[start], two[start].astype(np.uint32)
        order = np.lexsort((start, b, a))
        start, a, b = start[order], a[order], b[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return start, np.cumsum(fresh) - 1, a[fresh], b[fresh]


def bits_of(rows: pa.Table, kind: int) -> np.ndarray:
    """A block's answers of one kind, all buckets one after the other."""
    found = sorted((b, n, x) for k, b, n, x in zip(*[rows.column(c).to_pylist() for c in ("kind", "bucket", "n", "bits")], strict=True) if k == kind)
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for _, n, x in found]).astype(bool) if found else np.zeros(0, bool)


def answers(kind: int, bucket: int, owners: list[int], sizes: list[int], flags: np.ndarray) -> pa.Table:
    cut = np.concatenate(([0], np.cumsum(sizes)))
    bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip(cut, cut[1:])]
    n = len(owners)
    return pa.table({"block": pa.array(owners, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "n": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary())})


ANSWER = "block int, kind int, bucket int, n int, bits binary"
PACKED = "bucket int, block int, one binary, two binary, ids binary, at binary"


def packed(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    names = [f.split()[0] for f in PACKED.split(", ")]
    return pa.table({c: pa.array(v, k) for c, v, k in zip(names, list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256."""
    return _run(docs, id_col, text_col, RESULT, _digests)


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id and the words it keeps, joined by one space."""
    return _run(docs, id_col, text_col, "doc_id long, text string", _texts)


def _digests(block: Block, gone: np.ndarray) -> pa.Table:
    cut = np.concatenate(([0], np.cumsum(block.n_words)))
    removed = np.concatenate(([0], np.cumsum(gone)))
    removed = removed[cut[1:]] - removed[cut[:-1]]
    digests = [hashlib.sha256(t).hexdigest() for t in _kept(block, gone, cut, removed)]
    return pa.table({"doc_id": block.ids, "n_words": pa.array(block.n_words.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept_sha256": pa.array(digests, pa.string())})


def _texts(block: Block, gone: np.ndarray) -> pa.Table:
    cut = np.concatenate(([0], np.cumsum(block.n_words)))
    removed = np.concatenate(([0], np.cumsum(gone)))
    texts = [t.decode() for t in _kept(block, gone, cut, removed[cut[1:]] - removed[cut[:-1]])]
    return pa.table({"doc_id": block.ids, "text": pa.array(texts, pa.string())})


def _kept(block: Block, gone: np.ndarray, cut: np.ndarray, removed: np.ndarray):
    data = block.raw.tobytes()
    for i, (a, b) in enumerate(zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)):
        parts = data[a:b].split()  # of bytes: at space and tab to carriage return
        yield b" ".join(compress(parts, (~gone[cut[i] : cut[i + 1]]).tolist()) if removed[i] else parts)


def _run(docs: DataFrame, id_col: str, text_col: str, schema: str, finish) -> DataFrame:
    blocks, buckets = pieces(docs, BLOCK_BYTES, 36), pieces(docs, BUCKET_BYTES, 12)
    rows, *at = located(docs, *dict.fromkeys((id_col, text_col)))
    dealt = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(*at), F.lit(blocks)).cast("int").alias("block"))

    def send_anchors(table: pa.Table) -> pa.Table:
        distinct, *_ = Block(table).anchors()
        cut, me = bucket_cuts(distinct, buckets), table.column("block")[0].as_py()
        return packed([(b, me, planes(distinct[cut[b] : cut[b + 1]]), None, None, None) for b in range(buckets) if cut[b] < cut[b + 1]])

    def meet_anchors(table: pa.Table) -> pa.Table:
        parts = [from_planes(x, "<u8") for x in table.column("one").to_pylist()]
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        flags = np.zeros(len(every), bool)
        flags[order[1:][same]] = flags[order[:-1][same]] = True
        return answers(0, table.column("bucket")[0].as_py(), table.column("block").to_pylist(), [len(p) for p in parts], flags)

    def send_windows(table: pa.Table, said: pa.Table) -> pa.Table:
        if not len(table):
            return packed([])
        block = Block(table)
        start, group, one, two = block.windows(bits_of(said, 0))
        first = start[np.searchsorted(group, np.arange(len(one)))]  # in a group, the earliest word comes first
        ids = pc.fill_null(block.ids, NO_ID).to_numpy()
        cut, me, rows = bucket_cuts(one, buckets), table.column("block")[0].as_py(), []
        for b in range(buckets):
            own = slice(cut[b], cut[b + 1])
            if cut[b] < cut[b + 1]:
                names, at = np.unique(ids[block.docs[first[own]]], return_inverse=True)
                rows.append((b, me, planes(one[own]), planes(two[own]), names.astype("<i8").tobytes(), at.astype("<u2" if len(names) <= 1 << 16 else "<u4").tobytes()))
        return packed(rows)

    def meet_windows(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")  # equal ids: the lower block first
        one, two, ids, sizes = [], [], [], []
        for x, y, names, at in zip(*[table.column(c).to_pylist() for c in ("one", "two", "ids", "at")], strict=True):
            one.append(from_planes(x, "<u8"))
            two.append(from_planes(y, "<u4"))
            names = np.frombuffer(names, "<i8")
            ids.append(names[np.frombuffer(at, "<u2" if len(names) <= 1 << 16 else "<u4")])
            sizes.append(len(one[-1]))
        a, b, i = map(np.concatenate, (one, two, ids))
        order = np.lexsort((i, b, a))
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        flags = np.zeros(len(a), bool)
        flags[order[fresh]] = True
        return answers(1, table.column("bucket")[0].as_py(), table.column("block").to_pylist(), sizes, flags)

    def cut_out(table: pa.Table, said: pa.Table) -> pa.Table:
        block = Block(table)
        n = len(block.docs)
        start, group, one, _ = block.windows(bits_of(said, 0))
        repeat = np.ones(len(start), bool)
        if len(start):
            repeat[1:] = group[1:] == group[:-1]
            repeat[0] = False
            repeat |= ~bits_of(said, 1)[group]
        covers = np.zeros(n + 1, np.int64)
        covers[1 + start[repeat]] = 1
        covers = np.cumsum(covers)
        word = np.arange(n)
        return finish(block, covers[word + 1] > covers[np.maximum(word - WINDOW + 1, 0)])

    by_block = dealt.groupBy("block")
    shared = by_block.applyInArrow(lean_group(send_anchors), PACKED).groupBy("bucket").applyInArrow(lean_group(meet_anchors), ANSWER)
    found = by_block.cogroup(shared.groupBy("block")).applyInArrow(lean_group(send_windows), PACKED)
    firsts = found.groupBy("bucket").applyInArrow(lean_group(meet_windows), ANSWER)
    return by_block.cogroup(shared.unionByName(firsts).groupBy("block")).applyInArrow(lean_group(cut_out), schema)
