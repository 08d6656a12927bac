"""Byte-level BPE encoding and decoding by forced boundaries.

Two bytes that stand side by side inside no token of the vocabulary can't be
merged across, whatever is around them. So the text's words are cut between any such
two, the fragments are encoded each for itself, and their ids follow each other: the
cuts are certain, and the result is that of the whole word. Fragments are short, so
many of them advance together: in each round every fragment merges all places of its
best-ranked pair, found by one probe of the sorted merges. That equals merging one
place after the other where a merge only makes pairs of a later rank, which is tested
when the vocabulary is read; fragments of more than ``LONG`` bytes, and all of them
where the test fails, are merged by a heap.

Words are those of the byte-level split pattern. A single space between two characters
that aren't white space always begins a word, so texts are first cut there into
stretches, whose ids are remembered within a bound of bytes. Strings of special tokens
become their ids, as the ``tokenizers`` library does by default.

Decoding joins the bytes behind the ids; bytes that aren't UTF-8 become U+FFFD, and ids
outside the vocabulary nothing.

Null texts count as empty; empty texts have no ids. Repeated rows get equal ids, also
those without an id; an empty table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean
from .text_kernel import sliced

#: Fixed value: the split pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fragments of more bytes are merged one by one.
LONG = 48
#: Bytes that advance together.
STEP = 1 << 20
#: Bytes of remembered stretches, with about ``ENTRY_BYTES`` for each beside its text and ids; as much again is kept of the ones before.
REMEMBERED_BYTES, ENTRY_BYTES = 72 << 20, 200
NEVER = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = itertools.count(256)
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class BytePairs:
    """A byte-level BPE vocabulary, with encoding and decoding."""

    def __init__(self, path: str, remembered: int = REMEMBERED_BYTES) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, splitter = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or spec.get("normalizer") or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
            raise ValueError("only byte-level BPE vocabularies without a normalizer or a prefix space are supported")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("dropout, affixes and ignored merges aren't supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match anywhere, and themselves alone")
        letters = byte_letters()
        of = {c: b for b, c in enumerate(letters)}
        vocabulary: dict[str, int] = model["vocab"]
        tokens = {i: bytes(of[c] for c in t) for t, i in vocabulary.items() if all(c in of for c in t)}
        self.byte_id = np.array([vocabulary[c] for c in letters], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(WORDS)
        #: whether two bytes stand side by side inside some token
        self.inside = np.zeros((256, 256), bool)
        for t in tokens.values():
            b = np.frombuffer(t, np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.wide = max(vocabulary.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a, b, made = (np.array(x, np.int64) for x in zip(*[(vocabulary[x], vocabulary[y], vocabulary[x + y]) for x, y in pairs], strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        rank = np.arange(len(a))
        order = np.argsort(a * self.wide + b, kind="stable")
        self.keys, self.ranks, self.made = (a * self.wide + b)[order], rank[order], made[order]
        self.made_by_rank = made
        made_last = np.full(self.wide, -1, np.int64)
        np.maximum.at(made_last, made, rank)
        #: a merge only makes pairs of a later rank
        self.ordered = bool((rank > np.maximum(made_last[a], made_last[b])).all()) and len(np.unique(self.keys)) == len(self.keys)
        self.byte_ranks = self.ranked(self.byte_id[:, None], self.byte_id[None, :])
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        parts = [b""] * (max([self.wide - 1, *self.special.values()]) + 1)
        for i, t in tokens.items():
            parts[i] = t
        for t, i in self.special.items():
            parts[i] = t.encode()
        self.size = np.array([*map(len, parts)], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.remembered, self.held = remembered, 0

    # ---- fragments

    def merged(self, ids: list[int]) -> list[int]:
        """The best-ranked neighbours merge, the leftmost of equals first."""
        n = len(ids)
        parts: list[int] = list(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, wide = self.rank_of, self.wide
        heap = [(r, i, x * wide + y) for i, (x, y) in enumerate(itertools.pairwise(parts)) if (r := rank.get(x * wide + y)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, pair = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or parts[i] * wide + parts[j] != pair:  # one of the two has merged meanwhile
                continue
            parts[i], parts[j] = int(self.made_by_rank[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := rank.get(parts[x] * wide + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x] * wide + parts[y]))
        return [x for x in parts if x >= 0]

    def ranked(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, ``NEVER`` if it doesn't merge."""
        key = first * self.wide + second
        if not len(self.keys):
            return np.full(key.shape, NEVER)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def together(self, raw: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many fragments of bytes after all merges, with the fragment of each; owners ascend."""
        ids, done_ids, done_owner = self.byte_id[raw], [], []
        rank = np.full(len(ids), NEVER)  # of the pair that begins at each id
        rank[:-1] = np.where(owner[:-1] == owner[1:], self.byte_ranks[raw[:-1], raw[1:]], NEVER)
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            live = best < NEVER
            done_ids.append(ids[~live])
            done_owner.append(owner[~live])
            ids, owner, rank, best = ids[live], owner[live], rank[live], best[live]
            if not len(ids):
                break
            hit = rank == best
            place = np.arange(len(ids))
            run = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), place, 0))
            hit &= (place - run) % 2 == 0  # of overlapping places, every other one
            ids[hit] = self.made_by_rank[rank[hit]]
            keep = ~np.concatenate(([False], hit[:-1]))
            ids, owner, rank, hit = ids[keep], owner[keep], rank[keep], hit[keep]
            stale = hit.copy()  # pairs that begin or end at an id just made
            stale[:-1] |= hit[1:]
            at = np.flatnonzero(stale)
            after = np.minimum(at + 1, len(ids) - 1)
            inner = (after > at) & (owner[at] == owner[after])
            rank[at] = NEVER
            rank[at[inner]] = self.ranked(ids[at[inner]], ids[after[inner]])
        ids, owner = np.concatenate([raw[:0].astype(np.int64), *done_ids]), np.concatenate([owner[:0], *done_owner])
        order = np.argsort(owner, kind="stable")  # a fragment is done in one round, so its ids are in order
        return ids[order], owner[order]

    def fragments(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where fragments begin in bytes: at the words' starts and between two bytes that no token has side by side."""
        cut = np.ones(len(raw), bool)
        cut[1:] = ~self.inside[raw[:-1], raw[1:]]
        cut[starts] = True
        return np.flatnonzero(cut)

    def learn(self, stretches: list[str], apart: bool = True) -> list[bytes]:
        """Little-endian uint32 ids of each stretch; unless ``apart``, a word can't span two that are joined."""
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for x in stretches:
            some.append(x)
            size += len(x)
            if size >= STEP:
                out += self._learn(some, apart)
                some, size = [], 0
        return out + self._learn(some, apart)

    def _words(self, stretches: list[str], apart: bool) -> tuple[list[str], np.ndarray]:
        """The words, and the stretch of each; -1 - the stretch for the string of a special token."""
        if not apart and not (self.specials and self.specials.search("\n".join(stretches))):
            found = self.words.findall("".join(stretches))
            ends = np.cumsum([*map(len, stretches)])
            return found, np.searchsorted(ends, np.cumsum([0, *map(len, found)])[:-1], side="right")
        texts: list[str] = []
        owners: list[int] = []
        for i, x in enumerate(stretches):
            at = 0
            for m in self.specials.finditer(x) if self.specials else ():
                found = self.words.findall(x, at, m.start())
                texts += [*found, m[0]]
                owners += [*[i] * len(found), -1 - i]
                at = m.end()
            found = self.words.findall(x, at)
            texts += found
            owners += [i] * len(found)
        return texts, np.array(owners, np.int64)

    def _learn(self, stretches: list[str], apart: bool) -> list[bytes]:
        texts, owner = self._words(stretches, apart)
        if not texts:
            return [b""] * len(stretches)
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)[np.cumsum([0, *map(len, texts)])[:-1]]  # of words, in bytes
        cuts = self.fragments(raw, starts)
        length = np.diff(np.append(cuts, len(raw)))
        word = np.searchsorted(starts, cuts, side="right") - 1
        of = np.repeat(np.arange(len(cuts)), length)
        special = owner[word] < 0
        # the bytes of a special token's string may be cut in several fragments: the first stands for its id
        alone = special | (length > LONG) | (not self.ordered)
        easy = ~alone[of]
        some_ids, some_of = self.together(raw[easy], of[easy])
        more: list[tuple[int, list[int]]] = []
        for f in np.flatnonzero(alone).tolist():
            if special[f]:
                if cuts[f] == starts[word[f]]:
                    more.append((f, [self.special[texts[word[f]]]]))
            else:
                more.append((f, self.merged(self.byte_id[raw[cuts[f] : cuts[f] + length[f]]].tolist())))
        if more:
            some_ids = np.concatenate([some_ids, np.array([i for _, x in more for i in x], np.int64)])
            some_of = np.concatenate([some_of, np.repeat(np.array([f for f, _ in more], np.int64), [len(x) for _, x in more])])
            order = np.argsort(some_of, kind="stable")
            some_ids, some_of = some_ids[order], some_of[order]
        stretch = owner[word[some_of]]
        stretch = np.where(stretch < 0, -1 - stretch, stretch)
        ends = 4 * np.searchsorted(stretch, np.arange(len(stretches)), side="right")
        data = some_ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in itertools.pairwise([0, *ends.tolist()])]

    # ---- texts

    _runs = re.compile(r"\s\s")
    _between = re.compile(r"(?<=\S) (?=\S)")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        cut = [self._between.split(t) if self._runs.search(t) or t[:1].isspace() or t[-1:].isspace() else t.split(" ") for t in texts]
        if self.held > self.remembered:
            self.older, self.known, self.held = self.known, {}, 0
        known, older = self.known, self.older  # of stretches that a space stands before
        new: set[str] = set()
        for parts in cut:
            new.update(parts[1:])
        new.difference_update(known)
        if older and new:
            again = {x: older[x] for x in new if x in older}
            self._remember(again)
            new.difference_update(again)
        if new:
            self._remember(dict(zip(new, self.learn([" " + x for x in new], apart=False), strict=True)))
        alone = self.learn([parts[0] for parts in cut])
        return [b"".join([first, *map(known.__getitem__, parts[1:])]) for first, parts in zip(alone, cut, strict=True)]

    def _remember(self, found: dict[str, bytes]) -> None:
        self.known.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY_BYTES * len(found)

    def decode_all(self, coded: list[np.ndarray]) -> list[bytes]:
        """The UTF-8 texts of many arrays of ids, by one table lookup."""
        ids = np.concatenate([np.zeros(0, np.int64), *coded]).astype(np.int64)
        good = (ids >= 0) & (ids < len(self.size))
        ids = np.where(good, ids, 0)
        size = np.where(good, self.size[ids], 0)
        ends = np.concatenate(([0], np.cumsum(size)))
        data = self.bytes[np.arange(int(ends[-1])) + np.repeat(self.start[ids] - ends[:-1], size)].tobytes()
        cut = ends[np.concatenate(([0], np.cumsum([len(x) for x in coded]))).astype(np.int64)].tolist()
        texts = [data[a:b] for a, b in itertools.pairwise(cut)]
        return [x if x.isascii() else x.decode("utf-8", "replace").encode() for x in texts]


_LOADED: dict[tuple, BytePairs] = {}


def loaded(path: str) -> BytePairs:
    """The process's vocabulary of a file; what it remembers serves later tasks too."""
    key = (os.getpid(), path)
    if key not in _LOADED:
        _LOADED[key] = BytePairs(path)
    return _LOADED[key]


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = loaded(path)
        for whole in batches:
            for batch in sliced(whole, "text", 1 << 20):
                coded = pairs.encode([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()), *columns(pairs, coded)], names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), schema)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids of every document."""

    def columns(pairs: BytePairs, coded: list[bytes]) -> list[pa.Array]:
        flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
        offsets = np.cumsum([0, *[len(x) // 4 for x in coded]]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]

    return _mapped(docs, path, id_col, text_col, "doc_id long, n_tokens long, ids array<int>", columns)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, the sha256 of the little-endian uint32 ids, and that of the text decoded from them."""

    def columns(pairs: BytePairs, coded: list[bytes]) -> list[pa.Array]:
        back = pairs.decode_all([np.frombuffer(x, "<u4") for x in coded])
        return [pa.array([hashlib.sha256(x).hexdigest() for x in some], pa.string()) for some in (coded, back)]

    return _mapped(docs, path, id_col, text_col, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with ids; null ids give an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = loaded(path)
        for batch in batches:
            ids = [np.array([i for i in x or () if i is not None], np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode() for x in pairs.decode_all(ids)], pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids")).mapInArrow(lean(run), "doc_id long, text string")
