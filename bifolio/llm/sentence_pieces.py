"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy.

A text is cut into words that no piece can span. Distinct words of equal length
advance together: at each place, the hashes of the substrings that end there
probe the sorted keys of the pieces, the best piece is found by a vectorised
maximum, and its length is the backpointer.

What is best depends on the model's kind. In a unigram model it is the largest
sum of scores. A BPE model's scores are merge priorities, whose sums say
nothing. There the pass uses that a BPE encoding is the only sequence of pieces
in which each neighbouring pair, encoded alone, stays that pair: every prefix
has one encoding, with one last piece, and a piece may follow it exactly if the
pair stays. So the transition weight is 1 if it does and else 0, and the result
is the model's own encoding. A pair is judged by the merges that made its two
pieces, taken back from the last to the first: it stays if none of the pieces that
stood side by side at the border on the way would have merged before the next of
those merges. Pieces made by a merge that isn't worse than an earlier one of theirs
are judged by the merges themselves. Runs of spaces, whose pieces share one score,
are merged directly.

Characters without a piece become the pieces of their UTF-8 bytes, or the
unknown id where the model has none. Spaces become U+2581, one is put before
the text, and decoding takes these back; so decoding returns the text, but for
U+2581 in it, which becomes a space. Other normalisation than this (identity)
isn't done; ``Pieces`` refuses models that ask for it.

Null counts as empty, and empty texts have no ids. Repeated rows get equal ids;
an empty table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean
from .text_kernel import BASES, U, mix, sliced

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Cells of a Viterbi table (words x places x piece lengths) worked on at a time.
CELLS = 4_000_000
#: Judged pairs are remembered in so many slots, as a power of 2.
PAIR_BITS = 20
#: Bytes of remembered stretches, with about ``ENTRY_BYTES`` for each beside its text and ids; as much again is kept of the ones before.
REMEMBERED_BYTES, ENTRY_BYTES = 12 << 20, 200


class Pieces:
    """A model's pieces, with encoding and decoding."""

    def __init__(self, path: str, kind: int | None = None, remembered: int = REMEMBERED_BYTES) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            model = pb.ModelProto.FromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation, dummy prefix and escaped spaces are supported")
        self.kind = kind or model.trainer_spec.model_type
        self.unknown = model.trainer_spec.unk_id
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        self.ids = {p: i for i, p, _ in normal}
        self.score = {p: s for _, p, s in normal}
        self.text = [p.piece if p.type == 1 else "" for p in model.pieces]
        self.byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == 6}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space after another character")
        self.longest = max(map(len, self.ids), default=1)
        keys = np.array([self._key(p) for p in self.ids], U)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.ids.values()), np.int64)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a key")
        self.maybe = np.zeros(1 << 20, bool)  # a piece may have a key with these low bits
        self.maybe[(keys & U((1 << 20) - 1)).astype(np.int64)] = True
        self.weights = np.full(len(model.pieces), -np.inf)
        for i, _, s in normal:
            self.weights[i] = s
        self.alphabet = {p for p in self.ids if len(p) == 1}
        own = "".join(re.escape(c) for c in sorted(self.alphabet - {SPACE}))
        #: words that no piece spans: spaces and what follows of characters that are pieces; or one other character
        self.units = re.compile(f"{SPACE}+[{own}]*|[{own}]+|[^{own}{SPACE}]" if SPACE in self.alphabet else f"[{own}]+|[^{own}]", re.S)
        self.pair_keys = np.full(1 << PAIR_BITS, -1, np.int64)  # judged pairs, each at the slot of its hash
        self.pair_stays = np.zeros(1 << PAIR_BITS, bool)
        self.own = np.zeros(len(model.pieces), np.int8)  # 1: a piece that encodes to itself, -1: it doesn't, 0: not judged yet
        self.made = array("d", [math.nan]) * len(model.pieces)  # the score of the merge that made a piece: inf for characters, nan if its merges don't get worse in turn
        self.parts = array("i", [-1]) * (2 * len(model.pieces))  # the two pieces that this merge joined
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.remembered, self.held = remembered, 0
        parts = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text)]
        self.piece_size = np.array([len(x) for x in parts], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(parts), np.uint8)

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASES[0]) + ord(c) + 1) & ((1 << 64) - 1)
        return int(mix(np.array([h], U) + U(len(piece)))[0])

    # ---- one word, by the merges

    def merged(self, word: str, steps: list[tuple[str, str]] | None = None) -> list[str]:
        """The BPE encoding of a word: the best-scored neighbours merge, the leftmost of equals first. ``steps`` gets what merged, in turn."""
        parts: list[str | None] = list(word)
        n, score = len(parts), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-found, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (found := score.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or parts[i] + parts[j] != both:  # one of the two has merged meanwhile
                continue
            if steps is not None:
                steps.append((parts[i], parts[j]))
            parts[i], parts[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := score.get(both + parts[k])) is not None:
                    heapq.heappush(heap, (-found, i, both + parts[k]))
            h = before[i]
            if h >= 0 and (found := score.get(parts[h] + both)) is not None:
                heapq.heappush(heap, (-found, h, parts[h] + both))
        return [x for x in parts if x is not None]

    def stay(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether two pieces, encoded together, stay these two, for many pairs."""
        pair = first * len(self.text) + second
        slot = (mix(pair.astype(U)) >> U(64 - PAIR_BITS)).astype(np.int64)
        fresh = self.pair_keys[slot] != pair
        if fresh.any():
            new = np.unique(pair[fresh])
            one, two = np.divmod(new, len(self.text))
            found = self.alone(one) & self.alone(two)
            found[found] = list(map(self._stays, one[found].tolist(), two[found].tolist()))
            ok = self.pair_stays[slot]
            ok[fresh] = found[np.searchsorted(new, pair[fresh])]
            at = (mix(new.astype(U)) >> U(64 - PAIR_BITS)).astype(np.int64)
            self.pair_keys[at] = -1  # of pairs that meet in a slot none is kept
            kept = np.unique(at, return_index=True)[1]
            self.pair_keys[at[kept]], self.pair_stays[at[kept]] = new[kept], found[kept]
            return ok
        return self.pair_stays[slot]

    def _stays(self, a: int, b: int) -> bool:
        """The same for one pair of pieces that each encode to themselves."""
        text, score, made, parts = self.text, self.score, self.made, self.parts
        if made[a] != made[a] or made[b] != made[b]:
            return text[a] + text[b] not in score and self.merged(text[a] + text[b]) == [text[a], text[b]]
        until_a = until_b = -math.inf  # the scores of the merges that the two pieces at the border went into
        while True:
            across = score.get(text[a] + text[b])
            if across is not None and across > until_a and across >= until_b:  # of equals, the leftmost would have come first
                return False
            first, second = made[a], made[b]
            if second <= first:  # what the later merge made is taken apart
                if second == math.inf:
                    return True
                until_b, b = second, parts[2 * b]
            else:
                until_a, a = first, parts[2 * a + 1]

    def alone(self, ids: np.ndarray) -> np.ndarray:
        """Whether each piece, encoded, is itself."""
        own = self.own[ids]
        if not own.all():
            for i in np.unique(ids[own == 0]).tolist():
                self._judge(i)
            own = self.own[ids]
        return own == 1

    def _judge(self, i: int) -> None:
        """Whether a piece encodes to itself, and the last of the merges that make it."""
        steps: list[tuple[str, str]] = []
        word = self.text[i]
        self.own[i] = 1 if self.merged(word, steps) == [word] else -1
        if self.own[i] == 1 and not steps:
            self.made[i] = math.inf
        elif self.own[i] == 1:
            x, y = (self.ids[p] for p in steps[-1])
            self.parts[2 * i], self.parts[2 * i + 1] = x, y
            for part in (x, y):
                if not self.own[part]:
                    self._judge(part)
            if min(self.made[x], self.made[y]) > self.score[word] and self.made[x] == self.made[x] and self.made[y] == self.made[y]:
                self.made[i] = self.score[word]

    # ---- words of one length, by the Viterbi pass

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Piece ids of distinct words, all of one length and made of characters that are pieces."""
        return [np.frombuffer(x, "<u4").tolist() for x in self.coded(words)]

    def coded(self, words: list[str]) -> list[bytes]:
        """The same as little-endian uint32."""
        n, many = len(words[0]), len(words)
        if n == 1:
            return [pack("<I", self.ids[w]) for w in words]
        chars = np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(many, n).T).astype(U) + U(1)
        wide = min(n, self.longest)
        piece = np.full((n, wide, many), -1, np.int32)  # by the place where a substring ends, its length and the word
        h = np.zeros((n, many), U)
        for size in range(1, wide + 1):  # h[s]: the substrings that start at s
            h = h[: n - size + 1] * BASES[0] + chars[size - 1 :]
            key = mix(h + U(size))
            hit = np.flatnonzero(self.maybe[(key & U((1 << 20) - 1)).view(np.int64)].ravel())
            probe = key.ravel()[hit]
            at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            good = self.keys[at] == probe
            start, row = np.divmod(hit[good], many)
            piece[start + size - 1, size - 1, row] = self.key_ids[at[good]]
        best = np.full((n + 1, many), -np.inf)
        best[0] = 0
        back = np.zeros((n + 1, many), np.int32)
        last = np.full((n + 1, many), -1, np.int64)
        rows = np.arange(many)
        for end in range(1, n + 1):
            here = piece[end - 1, :end]
            if self.kind == UNIGRAM:
                size, row = np.nonzero(here >= 0)
                weight = np.full(here.shape, -np.inf)
                weight[size, row] = best[end - 1 - size, row] + self.weights[here[size, row]]
                pick = np.argmax(weight, axis=0)
                best[end], back[end] = weight[pick, rows], pick + 1
                last[end] = np.where(best[end] > -np.inf, here[pick, rows], -1)
                continue
            open_ = rows  # the longest pieces first: of those that end here one stays, so no other has to be judged
            for size in np.flatnonzero((here >= 0).any(axis=1))[::-1].tolist():
                p = here[size, open_]
                some = np.flatnonzero(p >= 0)
                row, p, start = open_[some], p[some].astype(np.int64), end - 1 - size
                ok = self.stay(last[start, row], p) if start else self.alone(p)
                row, p = row[ok], p[ok]
                best[end, row], back[end, row], last[end, row] = best[start, row] + 1, size + 1, p
                left = np.ones(len(open_), bool)
                left[some[ok]] = False
                open_ = open_[left]
                if not len(open_):
                    break
        if not (best[n] > -np.inf).all():
            raise ValueError(f"no encoding of {words[int(np.flatnonzero(best[n] == -np.inf)[0])]!r}")
        out = np.zeros((many, n), "<u4")  # each word's ids at the end of its row
        at, place, live = np.full(many, n), np.full(many, n), rows
        while len(live):
            place[live] -= 1
            out[live, place[live]] = last[at[live], live]
            at[live] -= back[at[live], live]
            live = live[at[live] > 0]
        data, wide = out.tobytes(), 4 * n
        return [data[a:b] for a, b in zip((rows * wide + 4 * place).tolist(), range(wide, wide * many + 1, wide), strict=True)]

    # ---- texts

    def learn(self, stretches: Iterable[str]) -> dict[str, bytes]:
        """Little-endian uint32 ids of distinct stretches, each with its spaces escaped and put before it."""
        units = self.units.findall
        cut = {x: units(x) for x in stretches}
        groups: dict[int, set[str]] = {}
        for parts in cut.values():
            for w in parts:
                if w[0] in self.alphabet and not w.startswith(SPACE * 2):
                    groups.setdefault(len(w), set()).add(w)
        done: dict[str, bytes] = {}
        for n, group in groups.items():
            words = sorted(group)
            step = max(1, CELLS // (n * min(n, self.longest)))
            for i in range(0, len(words), step):
                some = words[i : i + step]
                done.update(zip(some, self.coded(some), strict=True))
        for parts in cut.values():
            for w in parts:
                if w not in done:
                    done[w] = self._plain(w)
        return {x: done[parts[0]] if len(parts) == 1 else b"".join([done[w] for w in parts]) for x, parts in cut.items()}

    def _plain(self, word: str) -> bytes:
        if word[0] in self.alphabet and self.kind == UNIGRAM:  # starts with a run of spaces
            return self.coded([word])[0]
        if word[0] in self.alphabet:
            ids = [self.ids[p] for p in self.merged(word)]
        else:
            ids = [self.byte_ids.get(b, self.unknown) for b in word.encode()] if self.byte_ids else [self.unknown]
        return pack("<%dI" % len(ids), *ids)

    _runs = re.compile(f"  |{SPACE}")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        cut = [[] if not t else self._spaced(t) if self._runs.search(t) or t[0] == " " else t.split(" ") for t in texts]
        if self.held > self.remembered:
            self.older, self.known, self.held = self.known, {}, 0
        new = set()
        for parts in cut:
            new.update(parts)
        new.difference_update(self.known)
        if self.older and new:
            again = {x: self.older[x] for x in new if x in self.older}
            self._remember(again)
            new.difference_update(again)
        if new:
            found = self.learn([x if x[:1] == SPACE else SPACE + x for x in new])
            self._remember({x: found[x if x[:1] == SPACE else SPACE + x] for x in new})
        known = self.known
        return [b"".join([known[x] for x in parts]) for parts in cut]

    def _remember(self, found: dict[str, bytes]) -> None:
        self.known.update(found)
        self.held += sum(len(x) + len(ids) + ENTRY_BYTES for x, ids in found.items())

    @staticmethod
    def _spaced(text: str) -> list[str]:
        """Runs of spaces with what follows them, of a text that has some."""
        return re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))

    def decode_all(self, coded: list[np.ndarray]) -> list[bytes]:
        """The UTF-8 texts of many arrays of ids, by one table lookup; bytes that aren't UTF-8 become U+FFFD, control ids nothing."""
        ids = np.concatenate([np.zeros(0, np.int64), *coded]).astype(np.int64)
        size = self.piece_size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        data = self.piece_bytes[np.arange(int(ends[-1])) + np.repeat(self.piece_start[ids] - ends[:-1], size)].tobytes()
        cut = ends[np.concatenate(([0], np.cumsum([len(x) for x in coded]))).astype(np.int64)].tolist()
        texts = [data[a + (data[a : a + 1] == b" " and a < b) : b] for a, b in zip(cut, cut[1:])]
        return [x if x.isascii() else x.decode("utf-8", "replace").encode() for x in texts]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids."""
        return self.decode_all([np.array(list(ids), np.int64)])[0].decode()


_LOADED: dict[tuple, Pieces] = {}


def loaded(path: str, kind: int | None = None) -> Pieces:
    """The process's pieces of a model file; what they remember serves later tasks too."""
    key = (os.getpid(), path, kind)
    if key not in _LOADED:
        _LOADED[key] = Pieces(path, kind)
    return _LOADED[key]


def _mapped(docs: DataFrame, path: str, kind: int | None, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path, kind)
        names = [f.split()[0] for f in schema.split(", ")]
        for whole in batches:
            for batch in sliced(whole, "text", 1 << 20):
                coded = pieces.encode([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns(pieces, coded)], names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), schema)


def encoded(docs: DataFrame, path: str, kind: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids of every document."""

    def columns(pieces: Pieces, coded: list[bytes]) -> list[pa.Array]:
        sizes = np.array([len(x) // 4 for x in coded], np.int64)
        flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
        return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat))]

    return _mapped(docs, path, kind, id_col, text_col, "doc_id long, n_tokens long, ids array<int>", columns)


def round_trip(docs: DataFrame, path: str, kind: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, the crc32 of the little-endian uint32 ids, and the sha256 of the text decoded from them."""

    def columns(pieces: Pieces, coded: list[bytes]) -> list[pa.Array]:
        back = [hashlib.sha256(x).hexdigest() for x in pieces.decode_all([np.frombuffer(x, "<u4") for x in coded])]
        return [pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([zlib.crc32(x) for x in coded], pa.int64()), pa.array(back, pa.string())]

    return _mapped(docs, path, kind, id_col, text_col, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string", columns)


def decoded(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows with ids; null ids give an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode() for x in pieces.decode_all([np.array(x or [], np.int64) for x in batch.column(1).to_pylist()])], pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(lean(run), "doc_id long, text string")
