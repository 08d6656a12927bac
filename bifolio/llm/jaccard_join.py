"""Self-join of documents on the Jaccard similarity of their word shingles, exactly.

Documents with equal shingle sets form a class; one of them stands for it.
Classes are compared by universe partition: sets fall into size bands, two
linked sets lie in the same band or in neighbouring ones, and in the scheme of
the smaller one's band their symmetric difference has at most ``H`` elements.
The scheme hashes tokens into segments and gives segment i a threshold v_i of 1
(index the segment's tokens as they are) or 2 (index also every neighbour with
one token deleted) such that the v_i sum to H + 1 + spare. By the pigeonhole
principle linked sets then agree in segments of total weight over ``spare``,
where agreeing means equal for v = 1 and at most one token apart for v = 2. How many
segments get which threshold is the cheapest choice by a cost of index entries
and expected chance matches. Segments too short to tell (fewer tokens than
v_i) are left out, unless a set has so many of them that the guarantee would
be lost; then it indexes them all.

Index entries travel packed: each stretch of documents sends each bucket one row
with its hashes. Sets that share an entry are candidates. Their components are
only the first sieve, as passages that many texts share can chain them together.
The second compares sketches: a set's sketch has a bit for each of about as many
hash values as it has tokens, 1 where an odd number of its tokens fall. Two
sketches differ in no more bits than the sets in tokens, so no linked pair is
lost. Sets of neighbouring size bands are compared, some 0.1 byte a token. What
is left in components is compared token by token with a prefix filter in the
order of local token counts, and pairs already joined by other links are skipped,
so no list of all pairs arises. A component too large for one task is cut into
chunks, and each pair of chunks is a task.

The result has one row a document: n_shingles, and component_id, the least id
that can be reached by links. Null text and text without words have no
shingles and are linked with nothing. Rows are told apart by their place in their
file, so rows without an id link like others, and rows that share an id are
documents of their own; a component's name is the least id in it, null if it has
none. Repeated rows are copies of each other. Empty tables give empty results.
Only the columns named are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, lean_group, located, pieces, settled, skew_joined
from .components import connected, local_roots
from .text_kernel import U, ascii_lower, gram_hashes, mix, sliced, span_hashes, utf8, words

SHINGLE, PERCENT = 3, 90
#: Of the cost of a scheme: so many other sets share a passage with a set.
SHARING = 3
BUCKET_BYTES = 8 << 20
RANGE_ENTRIES = 200_000
#: A stretch of documents sends packets to so many ranges of buckets at most; ranges of many buckets are cut again, from so many bytes at a time.
FAN_OUT, CUT_BYTES = 256, 32 << 20
CHUNK_SETS, CHUNK_TOKENS = 2048, 1_000_000
#: A chunk of sketches, which take some 0.2 byte a token, has so many times as many sets and tokens. A set is copied once for each chunk of its component.
SKETCHES = 8
#: So many candidates of some 60 bytes (about 30 MB as a hash table) are sent to the scan of the texts; more are joined by a shuffle.
BROADCAST_UNITS = 500_000


# ---- sets -------------------------------------------------------------------


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): the sorted distinct shingle hashes of each text, one after the other."""
    raw, offsets = utf8(texts)
    n = len(offsets) - 1
    raw = ascii_lower(raw)
    starts, ends, docs = words(raw, offsets)
    h = span_hashes(raw, starts, ends)
    grams, valid = gram_hashes(h, docs, k)
    tokens, of = grams[valid], docs[valid]
    count = np.bincount(docs, minlength=n)
    for size in range(1, k):  # the whole sequence of a short text
        small, ok = gram_hashes(h, docs, size)
        ok &= count[docs] == size
        tokens, of = np.concatenate([tokens, mix(small[ok] + U(size))]), np.concatenate([of, docs[ok]])
    order = np.lexsort((tokens, of))
    tokens, of = tokens[order], of[order]
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])
    tokens, of = tokens[fresh], of[fresh]
    return tokens, np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n))))


def set_keys(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two arrays."""
    size = np.diff(offsets).astype(U)
    one = np.concatenate(([U(0)], np.cumsum(mix(tokens), dtype=U)))
    two = np.concatenate(([U(0)], np.cumsum(mix(tokens ^ U(0x5851F42D4C957F2D)), dtype=U)))
    a, b = one[offsets[1:]] - one[offsets[:-1]], two[offsets[1:]] - two[offsets[:-1]]
    return mix(a + size), mix(b ^ (size << U(32)))


# ---- schemes ----------------------------------------------------------------


@lru_cache(None)
def band_starts(most: int, percent: int) -> np.ndarray:
    """Least sizes of the bands, up to the one of ``most``: a set and its largest partner lie at most one band apart."""
    found = [1]
    while found[-1] <= most:
        found.append(found[-1] * 100 // percent + 1)
    return np.array(found, np.int64)


def weak_weight(t: float, ones: int, twos: int) -> float:
    """An upper bound, at three standard deviations, of the weight of the segments with fewer tokens than their v, at t tokens a segment."""
    one, two = math.exp(-t), math.exp(-t) * (1 + t)
    return ones * one + 2 * twos * two + 3 * math.sqrt(ones * one + 4 * twos * two)


@lru_cache(None)
def allocation(low: int, high: int, percent: int) -> tuple[int, int, int, int]:
    """(H, segments with v = 1, segments with v = 2, spare) for smaller sets of ``low`` to ``high`` tokens.

    ``spare`` is so large that few sets have more weight of weak segments. The
    cost of a scheme is its entries, and the tokens of the sets of ``SHARING``
    others, one with each of which a tenth of the tokens is shared, times the
    chance that they agree in a segment.
    """
    largest = high + high * 100 // percent
    most = largest * (100 - percent) // (100 + percent)
    size = (low + high) / 2
    best = None
    for twos in range(most + 2):
        for spare in range(1 if most >= 8 else 2, most + 24):
            ones = most + 1 + spare - 2 * twos
            if ones >= 0 and spare >= weak_weight(t := size / (ones + twos), ones, twos):
                break
        else:
            continue
        apart = 0.9 * t
        agree = math.exp(-2 * apart) * (1 - math.exp(-t / 10))
        cost = ones + twos * (1 + t) + SHARING * size * agree * (ones + twos * (1 + 2 * apart))
        if best is None or cost < best[0]:
            best = (cost, ones, twos, spare)
    if best is None:  # sets so small that some segment of each is weak
        spare = 2
        twos = (most + 1 + spare) // 2
        best = (0, most + 1 + spare - 2 * twos, twos, spare)
    return most, *best[1:]


def signatures(tokens: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, set number) of every index entry of every set: 48 bits, the lowest 1 if it is a whole segment, 0 if one token is left out."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    if not len(tokens):
        return np.zeros(0, U), np.zeros(0, np.int64)
    starts = band_starts(int(size.max()), percent)
    band = np.searchsorted(starts, size, side="right") - 1
    of = np.repeat(np.arange(n), size)
    hashed = mix(tokens ^ U(0xA0761D6478BD642F))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for scheme_of in (band, band - 1):
        used = np.unique(scheme_of[(size > 0) & (scheme_of >= 0)])
        table = np.zeros((len(starts) + 1, 4), np.int64)
        for b in used:
            table[b] = allocation(int(starts[b]), int(starts[b + 1] - 1), percent)
        own = table[np.maximum(scheme_of, 0)]
        active = (size > 0) & (scheme_of >= 0) & (own[:, 0] > 0)  # with H = 0 only equal sets link
        segments = np.where(active, own[:, 1] + own[:, 2], 0)
        first = np.concatenate(([0], np.cumsum(segments)))
        live = active[of]
        t, d = hashed[live], of[live]
        segment = ((t >> U(33)).astype(np.int64) * segments[d]) >> 31
        place = first[d] + segment  # a number for each (set, segment)
        total = int(first[-1])
        if not total:
            continue
        sums = np.zeros(total, U)
        np.add.at(sums, place, t)
        count = np.bincount(place, minlength=total)
        owner = np.repeat(np.arange(n), segments)
        number = np.arange(total) - first[owner]
        v = np.where(number < own[owner, 1], 1, 2)
        weak = count < v
        lost = np.bincount(owner, np.where(weak, v, 0), n) > own[:, 3]
        salt = mix((scheme_of[owner].astype(U) << U(32)) + number.astype(U) + U(1))
        keep = ~weak | lost[owner] | (count > 0)
        out.append((mix(sums[keep] ^ salt[keep]) >> U(17) << U(1) | U(1), owner[keep]))
        if (own[:, 2] > 0).any():
            pick = v[place] == 2
            pick &= (count[place] > 1) | lost[d]
            p = place[pick]
            out.append((mix((sums[p] - t[pick]) ^ salt[p]) >> U(17) << U(1), d[pick]))
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


# ---- sketches ---------------------------------------------------------------


def sketches(tokens: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each set's parity bits: a power of 2 of them, at least 64 and at least its size."""
    size = np.diff(offsets)
    width = 64 << np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / 64)).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(width)))
    of = np.repeat(np.arange(len(size)), size)
    bit = (mix(tokens ^ U(0xE7037ED1A0B428DB)) & (width[of] - 1).astype(U)).astype(np.int64)
    odd = np.zeros(int(first[-1]), np.uint8)
    np.bitwise_xor.at(odd, first[of] + bit, np.uint8(1))
    data = np.packbits(odd, bitorder="little").tobytes()
    return [data[a // 8 : b // 8] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def near_sketches(found: list[bytes], size: np.ndarray, percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """Roots of the sets under the pairs (with ``side``, of sets of side 0 and side 1) whose sketches, cut to the shortest, differ in no more bits than linked sets in tokens."""
    n = len(found)
    least = min(map(len, found))
    rows = np.empty((n, least // 8), U)
    for i, x in enumerate(found):  # a wider sketch, folded, is a narrower one
        rows[i] = np.bitwise_xor.reduce(np.frombuffer(x, U).reshape(-1, least // 8), axis=0)
    order = np.argsort(size, kind="stable") if side is None else np.lexsort((size, side))
    rows, size = rows[order], size[order].astype(np.int64)
    half = 0 if side is None else n - int(np.count_nonzero(side))
    others = size[half:]
    last = half + np.searchsorted(others, size * 100 // percent, side="right")
    first = np.arange(1, n + 1) if side is None else half + np.searchsorted(others, -(-size * percent // 100))
    joined = Joined(n)
    for i in range(n if side is None else half):
        some = slice(int(first[i]), int(last[i]))
        if some.start >= some.stop:
            continue
        apart = np.bitwise_count(rows[some] ^ rows[i]).sum(1, dtype=np.int64)
        for j in (some.start + np.flatnonzero(apart * (100 + percent) <= (size[some] + size[i]) * (100 - percent))).tolist():
            a, b = joined.find(i), joined.find(j)
            joined.up[max(a, b)] = min(a, b)
    roots = np.empty(n, np.int64)
    roots[order] = order[joined.roots(np.arange(n))]
    return roots


# ---- packed index entries ---------------------------------------------------


def packed(entries: np.ndarray, keys: np.ndarray) -> bytes:
    """Sorted entries byte plane by byte plane, then the set key of each as a place in a table of keys."""
    nodes, at = np.unique(keys, return_inverse=True)
    wide = 2 if len(nodes) <= 1 << 16 else 4
    planes = lambda x, width: np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes()
    return np.array([len(entries), len(nodes)], "<u4").tobytes() + planes(entries.astype("<u8"), 6) + nodes.astype("<u8").tobytes() + planes(at.astype("<u4"), wide)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, k = np.frombuffer(blob, "<u4", 2).astype(int)
    wide = 2 if k <= 1 << 16 else 4

    def whole(data: np.ndarray, kind: str) -> np.ndarray:
        out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        out[:, : len(data) // max(n, 1)] = data.reshape(-1, n).T
        return out.view(kind).ravel()

    entries = whole(np.frombuffer(blob, np.uint8, 6 * n, 8), "<u8")
    nodes = np.frombuffer(blob, "<u8", k, 8 + 6 * n)
    return entries, nodes[whole(np.frombuffer(blob, np.uint8, wide * n, 8 + 6 * n + 8 * k), "<u4")]


def by_range(parts: list[tuple[np.ndarray, np.ndarray]], each: int = RANGE_ENTRIES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A bucket's packets put together by ranges of entries, of about ``each`` entries; equal segments with and without a token left out stay together."""
    n = sum(len(e) for e, _ in parts)
    low, high = min(int(e[0]) for e, _ in parts), max(int(e[-1]) for e, _ in parts)
    edges = np.linspace(low, high, max(2, n // each + 2)).astype(U)[1:-1] & ~U(1)
    cuts = [np.concatenate(([0], np.searchsorted(e, edges), [len(e)])) for e, _ in parts]
    for r in range(len(edges) + 1):
        yield tuple(np.concatenate([p[side][c[r] : c[r + 1]] for p, c in zip(parts, cuts, strict=True)]) for side in (0, 1))


def chain(nodes: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all nodes of a root, each node having two at most; in random order, as contraction by least names takes a round for each node of a sorted chain."""
    order = np.lexsort((mix(np.arange(len(roots), dtype=U)), roots))
    same = roots[order][1:] == roots[order][:-1]
    return nodes[order[:-1][same]], nodes[order[1:][same]]


def shared_entries(entries: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all keys with a common entry, at most two a key.

    Segments at most one token apart are equal or one is the other without a
    token, so an entry counts only where a whole segment has it: two segments that
    become equal by leaving out a token each are two tokens apart.
    """
    nodes, at = np.unique(keys, return_inverse=True)
    order = np.argsort(entries, kind="stable")
    hashed, k = entries[order] | U(1), at[order]
    same = hashed[1:] == hashed[:-1]
    group = np.concatenate(([0], np.cumsum(~same)))
    whole = np.bincount(group, (entries[order] & U(1)).astype(float)) > 0
    same &= whole[group[1:]]
    root = local_roots(k[:-1][same], k[1:][same], len(nodes))
    return chain(nodes, root)


# ---- comparison -------------------------------------------------------------


class Joined:
    """Union-find over set numbers."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def roots(self, some: np.ndarray) -> np.ndarray:
        r = self.up[some]
        while True:
            up = self.up[r]
            if np.array_equal(up, r):
                return r
            r = up


def compare(tokens: np.ndarray, offsets: np.ndarray, side: np.ndarray, cross: bool, percent: int) -> np.ndarray:
    """Roots of the sets under all links between them (with ``cross``, between sets of side 0 and side 1)."""
    n = len(offsets) - 1
    joined = Joined(n)
    values, number, frequency = np.unique(tokens, return_inverse=True, return_counts=True)
    size = np.diff(offsets)
    sets = [number[offsets[i] : offsets[i + 1]] for i in range(n)]
    postings: dict[int, list[int]] = {}
    here = np.zeros(len(values), bool)
    order = np.lexsort((size, side)) if cross else np.argsort(size, kind="stable")
    for i in order.tolist():
        s = sets[i]
        if not len(s):
            continue
        least = -(-int(size[i]) * percent // 100)  # a partner has at least so many tokens, and shares at least so many
        prefix = s[np.argsort(frequency[s], kind="stable")[: int(size[i]) - least + 1]].tolist()
        if not cross or side[i] == 1:
            seen = [postings[x] for x in prefix if x in postings]
            if seen:
                near = np.unique(np.concatenate([np.array(x) for x in seen]))
                near = near[(100 * size[near] >= percent * size[i]) & (percent * size[near] <= 100 * size[i])]
                near = near[joined.roots(near) != joined.find(i)]
                here[s] = True
                while len(near):
                    some, near = near[:32], near[32:]
                    parts = [sets[j] for j in some]
                    inter = np.add.reduceat(here[np.concatenate(parts)].astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in parts])[:-1])))
                    hits = some[100 * inter >= percent * (size[some] + size[i] - inter)]
                    for j in hits.tolist():
                        a, b = joined.find(i), joined.find(j)
                        joined.up[max(a, b)] = min(a, b)
                    if len(hits) and len(near):
                        near = near[joined.roots(near) != joined.find(i)]
                here[s] = False
        if not cross or side[i] == 0:
            for x in prefix:
                postings.setdefault(x, []).append(i)
    return joined.roots(np.arange(n))


# ---- the join ---------------------------------------------------------------

SETS = "doc_id long, file long, row long, n long, band int, k1 long, k2 long, sketch binary"


def set_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The documents (SETS), and by set (k1, k2): n, copies (how many documents have it), and least: (null, doc_id, file, row) of the first document that links reach."""
    source, file, row = located(docs, *dict.fromkeys((id_col, text_col)))
    narrow = source.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(file).alias("file"), F.col(row).alias("row"))
    buckets = pieces(narrow, BUCKET_BYTES, 12)
    widths = [1]
    while -(-buckets // widths[0]) > FAN_OUT:
        widths.insert(0, widths[0] * FAN_OUT)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", 1 << 20):
                tokens, offsets = shingle_sets(batch.column(1), shingle)
                k1, k2 = set_keys(tokens, offsets)
                size = np.diff(offsets)
                band = np.searchsorted(band_starts(int(size.max(initial=1)), percent), size, side="right") - 1
                columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(size), pa.array(band.astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(sketches(tokens, offsets), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SETS.split(", ")])

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, "text", 1 << 20):
                tokens, offsets = shingle_sets(batch.column(0), shingle)
                k1, _ = set_keys(tokens, offsets)
                entries, of = signatures(tokens, offsets, percent)
                if not len(entries):
                    continue
                keys = k1[of]
                order = np.lexsort((keys, entries))
                entries, keys = entries[order], keys[order]
                fresh = np.ones(len(entries), bool)
                fresh[1:] = (entries[1:] != entries[:-1]) | (keys[1:] != keys[:-1])
                entries, keys = entries[fresh], keys[fresh]
                yield packets(entries, keys, buckets, widths[0])

    rows = settled(narrow.mapInArrow(lean(measure), SETS), "jaccard-sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row"))
    classes = settled(rows.filter("n > 0").groupBy("k1", "k2").agg(first.alias("rep"), F.first("n").alias("n"), F.first("band").alias("band"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")), "jaccard-classes")

    def meet(table: pa.Table) -> pa.Table:
        found = [link for entries, keys in by_range([unpacked(x) for x in table.column("entries").to_pylist()]) for link in [shared_entries(entries, keys)]]
        return pa.table({c: np.concatenate([x[i] for x in found]).view(np.int64) for i, c in enumerate("ab")})

    candidates = connected(in_buckets(narrow.select("text").mapInArrow(lean(index), PACKET), buckets, widths).groupBy("bucket").applyInArrow(lean_group(meet), "a long, b long"))

    # second sieve: sketches, by component and pair of neighbouring bands
    grouped = settled(classes.join(candidates.toDF("k1", "cluster"), "k1").withColumn("zone", F.explode(F.array("band", F.col("band") + 1))), "jaccard-candidates")

    def filtered(table: pa.Table) -> pa.Table:
        k1 = table.column("k1").to_numpy()
        side = table.column("side").to_numpy() if table.column("i")[0] != table.column("j")[0] else None
        roots = near_sketches(table.column("sketch").to_pylist(), table.column("n").to_numpy(), percent, side)
        a, b = chain(k1, roots)
        return pa.table({"a": a, "b": b})

    near = chunk_pairs(grouped.select("cluster", "zone", "k1", "k2", "n", "sketch"), ["cluster", "zone"], SKETCHES).groupBy("cluster", "zone", "i", "j").applyInArrow(lean_group(filtered), "a long, b long")
    clusters = connected(near.filter("a <> b"))

    # what is left: token by token
    left = settled(classes.select("k1", "k2", "n", F.col("rep.file").alias("file"), F.col("rep.row").alias("row")).join(clusters.toDF("k1", "cluster"), "k1"), "jaccard-units")
    units = chunk_pairs(left, ["cluster"]).groupBy("file", "row").agg(F.collect_list(F.struct("cluster", "i", "j", "side")).alias("at"))  # as many as the component has chunks
    units = F.broadcast(units) if left.count() <= BROADCAST_UNITS else units
    spread = narrow.join(units, ["file", "row"]).select("text", F.explode("at").alias("u")).select("u.*", "text")

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tokens, offsets = shingle_sets(table.column("text"), shingle)
        k1, k2 = set_keys(tokens, offsets)
        n = len(k1)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        roots = compare(tokens, offsets, table.column("side").to_numpy(), i != j, percent)
        name = np.array([f"{k1[r]:016X}{k2[r]:016X}" for r in range(n)], object)
        a, b = chain(name, roots)
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    roots = connected(spread.groupBy("cluster", "i", "j").applyInArrow(lean_group(verify), "a string, b string"))
    named = classes.withColumn("node", F.concat(*[F.lpad(F.hex(k), 16, "0") for k in ("k1", "k2")]))
    linked = settled(named.join(roots, "node").select("k1", "k2", "root", "rep"), "jaccard-linked")
    moved = linked.join(linked.groupBy("root").agg(F.min("rep").alias("least")), "root").select("k1", "k2", "least")
    whole = classes.join(moved, ["k1", "k2"], "left").select("k1", "k2", "copies", F.coalesce("least", "rep").alias("least"))
    return rows, settled(whole, "jaccard-components")


PACKET = "bucket int, entries binary"


def packets(entries: np.ndarray, keys: np.ndarray, buckets: int, width: int) -> pa.RecordBatch:
    """A packet for each range of ``width`` buckets that some of the sorted entries fall in, by the range's first bucket."""
    bucket = ((entries >> U(16)) * U(buckets) >> U(32)).astype(np.int64)
    first, cut = np.unique(bucket - bucket % width, return_index=True)
    ends = [*cut[1:], len(entries)]
    return pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array([packed(entries[a:b], keys[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())], ["bucket", "entries"])


def in_buckets(found: DataFrame, buckets: int, widths: list[int]) -> DataFrame:
    """Packets for single buckets of packets for ranges of ``widths[0]`` buckets.

    Each level deals the packets by range, and evenly within one, and cuts what a
    task gets into the next narrower ranges, ``CUT_BYTES`` at a time. So the number
    of packets grows with the input, not with the product of stretches and buckets.
    """
    for width in widths[1:]:

        def cut(batches: Iterable[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[bytes]] = {}
            size = 0

            def emptied() -> Iterator[pa.RecordBatch]:
                for first in sorted(held):
                    entries, keys = map(np.concatenate, zip(*map(unpacked, held[first]), strict=True))
                    order = np.argsort(entries, kind="stable")
                    yield packets(entries[order], keys[order], buckets, width)
                held.clear()

            for batch in batches:
                for first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held.setdefault(first, []).append(data)
                    size += len(data)
                    if size >= CUT_BYTES:
                        yield from emptied()
                        size = 0
            yield from emptied()

        # a task has one range, or few: ranges are dealt in order, each over as many tasks as it has bytes for
        lot = F.pmod(F.xxhash64("entries"), F.lit(max(1, buckets * BUCKET_BYTES // (256 << 20) // FAN_OUT + 1)))
        found = found.withColumn("lot", lot).repartition("bucket", "lot").sortWithinPartitions("bucket").drop("lot").mapInArrow(lean(cut), PACKET)
    return found


def chunk_pairs(members: DataFrame, key: list[str], times: int = 1) -> DataFrame:
    """The members of each key with more than one, once for each pair of chunks (i, j) that has theirs; ``side`` is 1 in j where i < j. Chunks are ``times`` the usual size."""
    sizes = members.groupBy(*key).agg(F.greatest(F.ceil(F.count(F.lit(1)) / (times * CHUNK_SETS)), F.ceil(F.sum("n") / (times * CHUNK_TOKENS))).cast("int").alias("chunks"), F.count(F.lit(1)).alias("members"))
    dealt = members.join(sizes.filter("members > 1").drop("members"), key).withColumn("chunk", F.pmod(F.hash("k2"), "chunks"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return each.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).withColumn("side", (F.col("chunk") > F.col("other")).cast("int")).drop("chunks", "chunk", "other")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows, sets = set_components(docs, id_col, text_col, shingle, percent)
    some = skew_joined(rows.filter("n > 0").select("doc_id", "n", "k1", "k2"), sets, ["k1", "k2"], "copies")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.select("doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id")).unionByName(alone)


def later_in_group(docs_sets: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(file, row) of the documents that aren't the first of their component: by id, rows without one last, then by place."""
    rows, sets = docs_sets
    some = skew_joined(rows.filter("n > 0").select("file", "row", "k1", "k2"), sets.withColumn("first", F.struct("least.file", "least.row")).drop("least"), ["k1", "k2"], "copies")
    return some.filter((F.col("file") != F.col("first.file")) | (F.col("row") != F.col("first.row"))).select("file", "row")
