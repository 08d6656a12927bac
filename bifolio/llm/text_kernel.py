"""Whole-batch text primitives on Arrow buffers with numpy.

All of them see the UTF-8 bytes of many documents as one array, so a batch
costs a fixed number of numpy calls, however many documents it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multipliers of the polynomial hashes; arbitrary, but part of the results' identity within a run.
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
INVERSES = tuple(U(pow(int(b), -1, 1 << 64)) for b in BASES)


def sliced(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each part has about ``most`` bytes of text; a longer single row stays whole."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)).astype(np.int64)
    if not len(sizes):
        return
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_utf8()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    return _LOWER[raw]


def words(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of bytes that aren't in ``gap``; a run ends with its document."""
    n = len(raw)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(gap[raw], out=inside[1:-1])
    before, here = inside[:-2].copy(), inside[1:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    before[cuts] = False
    starts = np.flatnonzero(here & ~before)
    after = inside[2:].copy()
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(here & ~after) + 1
    docs = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, docs


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(which: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, U)
        have[0] = U(1)
        done = 1
        while done < size:  # doubling
            take = min(done, size - done)
            have[done : done + take] = have[:take] * U(int(have[done - 1]) * int(BASES[which]) % (1 << 64))
            done += take
        _POWERS[which] = have
    return have[:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length: sums of byte * base**(position from the span's end), mixed."""
    if not len(starts):
        return np.zeros(0, U)
    # spans are disjoint and ordered: gather only their bytes, one polynomial digit a byte
    longest = int((ends - starts).max())
    pw = powers(which, longest + 1)
    size = (ends - starts).astype(np.int64)
    if size.sum() > 4 * len(raw) + 64:
        raise ValueError("spans overlap too much")
    at = np.cumsum(size) - size
    index = np.arange(int(size.sum()), dtype=np.int64)
    from_end = np.repeat(at + size - 1, size) - index
    src = index + np.repeat(starts - at, size)
    terms = (raw[src].astype(U) + U(1)) * pw[from_end]
    return mix(np.add.reduceat(terms, at) + size.astype(U) * U(0xD6E8FEB86659FD93))


def gram_hashes(hashes: np.ndarray, docs: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid) of the k items that start at each place; valid where they are of one document."""
    n = len(hashes)
    out = np.zeros(n, U)
    if n >= k:
        acc = np.zeros(n - k + 1, U)
        for i in range(k):
            acc *= BASES[which]
            acc += hashes[i : n - k + 1 + i]
        out[: n - k + 1] = mix(acc)
    valid = np.zeros(n, bool)
    if n >= k:
        valid[: n - k + 1] = docs[k - 1 :] == docs[: n - k + 1]
    return out, valid
