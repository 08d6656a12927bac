"""Collocations: phrases of 2 to 5 words that are more frequent than their parts suggest, by hierarchical pair naming.

Texts are lower-cased (A-Z), split at ``. , ; : ! ?`` and line ends into pieces, and
these into words. A phrase of k words is named as the pair of the names of its first
and its last k - 1 words; only pairs of frequent names get one, as no phrase is more
frequent than a part of it. The two names are also parent pointers: following left
ones gives the first words of a phrase, right ones the last, so the counts for each
cut and the test for being part of a longer phrase are found by joins on them.

A corpus is cut once in blocks of some MB. A block counts its distinct words or pairs
itself, so a word that a third of all texts repeat is counted once a block. The counts
go in packets to buckets by a hash of the word or pair, some million a bucket, where they
are summed over all blocks; the sums of at least ``least`` are named and sent back to the
blocks that hold the pair, where the sequence of names is replaced by that of pairs. There
are never more packets than distinct words or pairs of blocks. Sequences and counts of
each length are written to the shared folder, so nothing is counted twice and a lost
executor repeats one step. Words are compared as they are, pairs by the names of their
parts: hashes only choose the bucket.

All counts are exact (products as decimals of 38 digits). Null texts count as empty,
null languages as ``und``; ids aren't read, so rows without or with repeated ids count
like others. Ties in the score go to the more frequent phrase, then to the first in
byte order. Without a frequent phrase, as in an empty table, the result is empty. Only
the columns named are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, lean, lean_group, pieces, removed, settled, settled_at, skew_joined
from .text_kernel import BASES, U, ascii_lower, mix, span_hashes, utf8, words

LEAST, LONGEST, TOP = 100, 5, 2000
BLOCK_BYTES = 6 << 20
#: About so many distinct words or pairs of blocks are summed together.
BUCKET_KEYS, LEAST_BUCKETS = 1 << 19, 8
SALTS = 64
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _ENDS.copy()
_GAP[[9, 32]] = True
_CODEC = pa.Codec("zstd", 1)
#: What a block writes: a row of its own with the sequence that its words or pairs come from, and one for each bucket with some of these. ``base`` is the place of the first of them in the block.
WRITTEN = "block long, size long, seq binary, names binary, bucket int, base long, data binary, words binary, langs array<string>"


def _compressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def _plain(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers of one length, compressed: all first bytes of a column together, then all second ones, so that small numbers take little."""
    return bytes([len(columns)]) + _compressed(b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns))


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(_plain(data[1:]), np.uint8)
    return tuple(np.ascontiguousarray(c.reshape(8, -1).T).view("<i8").ravel() for c in np.split(raw, data[0]))


def _dense(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the place of each among them, and their counts, of keys from 0 to ``most``."""
    counts = np.bincount(keys, minlength=most)
    found = np.flatnonzero(counts)
    place = np.zeros(most, np.int64)
    place[found] = np.arange(len(found))
    return found, place[keys], counts[found]


def block(texts: pa.Array, langs: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray] | None:
    """The sequence of word names of some texts, with the language, word and count behind each name; None without words."""
    raw, offsets = utf8(texts)
    raw = ascii_lower(raw)
    starts, ends, docs = words(raw, offsets, _GAP)
    if not len(starts):
        return None
    closed = np.cumsum(_ENDS[raw], dtype=np.int32)[starts]
    fresh = np.zeros(len(starts), bool)  # words that begin a piece
    fresh[1:] = (docs[1:] != docs[:-1]) | (closed[1:] != closed[:-1])
    inside = raw[~_GAP[raw]]
    at = np.concatenate(([0], np.cumsum(ends - starts)))
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(inside)).dictionary_encode()
    langs = pc.fill_null(langs.cast(pa.large_utf8()), "und").dictionary_encode()
    langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    many = len(found.dictionary)
    key = np.asarray(langs.indices).astype(np.int64)[docs] * many + np.asarray(found.indices)
    names, own, counts = _dense(key, many * len(langs.dictionary))
    sequence = np.full(len(own) + int(fresh.sum()), -1, np.int64)
    sequence[np.arange(len(own)) + np.cumsum(fresh)] = own
    return sequence, langs.dictionary.take(pa.array(names // many)), found.dictionary.take(pa.array(names % many)), counts


def _dealt(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Places for names so that those of a bucket follow each other: the names in that order, the place of each name and of -1, and (bucket, first, end) of each bucket."""
    order = np.argsort(buckets, kind="stable")
    place = np.full(len(order) + 1, -1, np.int64)  # the last one serves -1
    place[order] = np.arange(len(order))
    found, first = np.unique(buckets[order], return_index=True)
    return order, place, [*zip(found.tolist(), first.tolist(), [*first.tolist(), len(order)][1:], strict=True)]


def _ranked(sequence: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence by ranks, the most frequent name first, as small numbers take little; and the name of each rank."""
    order = np.argsort(-np.bincount(sequence[sequence >= 0], minlength=many), kind="stable")
    rank = np.full(many + 1, -1, np.int64)
    rank[order] = np.arange(many)
    return rank[sequence], order


def _batch(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("seq", pa.binary()), ("names", pa.binary()), ("bucket", pa.int32()), ("base", pa.int64()), ("data", pa.binary()), ("words", pa.binary()), ("langs", pa.list_(pa.string()))])
    return pa.RecordBatch.from_pylist(rows, schema)


def word_blocks(docs: DataFrame, lang_col: str, text_col: str, block_bytes: int, buckets: int) -> DataFrame:
    """WRITTEN rows of the words."""

    def written(number: int, texts: pa.Array, langs: pa.Array) -> pa.RecordBatch:
        found = block(texts, langs)
        if found is None:
            return _batch([])
        sequence, langs, terms, counts = found
        codes = langs.dictionary_encode()
        raw, at = utf8(terms)
        order, place, parts = _dealt((span_hashes(raw, at[:-1], at[1:]) % U(buckets)).astype(np.int64))
        code, terms, counts = np.asarray(codes.indices)[order], terms.take(pa.array(order)).to_pylist(), counts[order]
        ranks, names = _ranked(place[sequence], len(order))
        rows = [{"block": number, "size": len(ranks), "seq": packed(ranks), "names": packed(names)}]
        rows += [{"block": number, "bucket": k, "base": a, "data": packed(code[a:b], counts[a:b]), "words": _compressed("\n".join(terms[a:b]).encode()), "langs": codes.dictionary.to_pylist()} for k, a, b in parts]
        return _batch(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, some, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            some.append(batch)
            size += batch.nbytes
            if size >= block_bytes:
                table, some, size = pa.Table.from_batches(some), [], 0
                yield written((task << 32) + made, table.column(1).cast(pa.large_utf8()), table.column(0))
                made += 1
        if some:
            table = pa.Table.from_batches(some)
            yield written((task << 32) + made, table.column(1).cast(pa.large_utf8()), table.column(0))

    narrow = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(lean(run), WRITTEN)


def pairs_of(own: np.ndarray, names: np.ndarray, buckets: int):
    """The pairs of neighbours in a sequence: their places (-1 where there is none), their two names, their counts, and the buckets of the places. The same each time."""
    ok = (own[:-1] >= 0) & (own[1:] >= 0)
    pairs, found, counts = np.unique(own[:-1][ok] * len(names) + own[1:][ok], return_inverse=True, return_counts=True)
    a, b = names[pairs // len(names)], names[pairs % len(names)]
    order, place, parts = _dealt((mix(a.astype(U) * BASES[0] + b.astype(U)) % U(buckets)).astype(np.int64))
    places = np.full(len(ok), -1, np.int64)
    places[ok] = place[found]
    return places, a[order], b[order], counts[order], parts


def frequent(places: np.ndarray, local: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of what is frequent (places ``local`` with their global ids), by ranks, and the id of each rank."""
    to = np.full(int(max(places.max(initial=-1), local.max(initial=-1))) + 2, -1, np.int64)  # the last one serves -1
    to[local] = np.arange(len(local))
    own = to[places]
    own = own[(own >= 0) | np.concatenate(([True], own[:-1] >= 0))]  # one gap is as good as many
    ranks, order = _ranked(own, len(local))
    return ranks, ids[order]


def pair_blocks(blocks: DataFrame, replies: DataFrame, before: int | None, buckets: int) -> DataFrame:
    """WRITTEN rows of the pairs of what is frequent in each block, from the rows and replies of the length before: words, or pairs that were dealt to ``before`` buckets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.Table.from_batches([_batch([])])
        if not left.num_rows or not right.num_rows:
            return none
        (number,), (sequence,), (names,) = (left.column(c).to_pylist() for c in ("block", "seq", "names"))
        (sequence,), (names,) = unpacked(sequence), unpacked(names)
        places = np.append(names, -1)[sequence] if before is None else pairs_of(sequence, names, before)[0]
        local, ids = (np.concatenate(x) for x in zip(*map(unpacked, right.column("data").to_pylist()), strict=True))
        own, names = frequent(places, local, ids)
        places, a, b, counts, parts = pairs_of(own, names, buckets)
        if not len(a):
            return none
        rows = [{"block": number, "size": len(own), "seq": packed(own), "names": packed(names)}]
        rows += [{"block": number, "bucket": k, "base": i, "data": packed(a[i:j], b[i:j], counts[i:j])} for k, i, j in parts]
        return pa.Table.from_batches([_batch(rows)])

    own = blocks.filter("bucket is null").select("block", "seq", "names")
    back = replies.filter("block is not null").select(F.col("block").alias("of"), "data")
    return own.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(lean_group(run), WRITTEN)


def summed(blocks: DataFrame, least: int, words_too: bool) -> DataFrame:
    """The sums of a bucket over all blocks: id, its words or pair, and f of what occurs at least so often; replies (block, data) with the places and ids of these in each block; and for words the number of all by language (without an id)."""
    kinds = [("lang", pa.string()), ("word", pa.string())] if words_too else [("a", pa.int64()), ("b", pa.int64())]
    schema = pa.schema([("id", pa.int64()), *kinds, ("f", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        packets = table.to_pylist()
        columns = [unpacked(r["data"]) for r in packets]
        counts = np.concatenate([c[-1] for c in columns])
        if words_too:
            terms = pa.array([w for r in packets for w in _plain(r["words"]).decode().split("\n")], pa.large_string()).dictionary_encode()
            langs = pa.concat_arrays([pa.array(r["langs"], pa.string()).take(pa.array(c[0])) for r, c in zip(packets, columns, strict=True)]).dictionary_encode()
            first, second = np.asarray(langs.indices).astype(np.int64), np.asarray(terms.indices).astype(np.int64)
        else:
            first, second = (np.concatenate([c[i] for c in columns]) for i in (0, 1))
        order = np.lexsort((second, first))
        x, y = first[order], second[order]
        fresh = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        starts = np.flatnonzero(fresh)
        sums = np.add.reduceat(counts[order], starts)
        often = np.flatnonzero(sums >= least)
        ids = np.full(len(starts), -1, np.int64)
        ids[often] = (packets[0]["bucket"] << 32) + np.arange(len(often))
        own = np.empty(len(order), np.int64)
        own[order] = ids[np.cumsum(fresh) - 1]
        x, y = x[starts[often]], y[starts[often]]
        if words_too:
            x, y = langs.dictionary.take(pa.array(x)), terms.dictionary.take(pa.array(y)).cast(pa.string())
        out = [pa.table([pa.array(ids[often]), pa.array(x), pa.array(y), pa.array(sums[often]), pa.nulls(len(often), pa.int64()), pa.nulls(len(often), pa.binary())], schema=schema)]
        replies, at = [], 0
        for r, c in zip(packets, columns, strict=True):
            found = own[at : at + len(c[-1])]
            at += len(c[-1])
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                replies.append({"block": r["block"], "data": packed(r["base"] + hit, found[hit])})
        if words_too:
            totals = np.bincount(first, counts, len(langs.dictionary)).astype(np.int64)
            replies += [{"lang": lang, "f": n} for lang, n in zip(langs.dictionary.to_pylist(), totals.tolist(), strict=True)]
        return pa.concat_tables([*out, pa.Table.from_pylist(replies, schema)])

    packets = blocks.filter("bucket is not null").select("bucket", "block", "base", "data", *(["words", "langs"] if words_too else []))
    kinds = "lang string, word string" if words_too else "a long, b long"
    return packets.groupBy("bucket").applyInArrow(lean_group(run), f"id long, {kinds}, f long, block long, data binary")


def _phrases(names: DataFrame, before: DataFrame) -> DataFrame:
    """The phrases of names (id, a, b, f), from those one word shorter: their words, and the counts of the first and last words of each cut."""
    a = before.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("pa"), F.col("f").alias("fa"), F.col("firsts").alias("sa"))
    b = before.select(F.col("id").alias("b"), F.col("last").alias("last"), F.col("f").alias("fb"), F.col("rests").alias("sb"))
    return names.join(a, "a").join(b, "b").select(
        "id", "a", "b", "lang", F.concat_ws(" ", "pa", "last").alias("phrase"), "last", "f",
        F.concat("sa", F.array("fa")).alias("firsts"), F.concat(F.array("fb"), "sb").alias("rests"),
    )


#: 1000 * a * n / (l * r), rounded down; decimals of 38 digits hold the products.
_SCORE = "cast(1000 * cast(a as decimal(19,0)) as decimal(22,0)) * cast(n as decimal(16,0)) div (cast(firsts[k] as decimal(19,0)) * cast(rests[k] as decimal(19,0)))"


def _cut(candidates: DataFrame) -> DataFrame:
    """l, r and score of the cut with the lowest score, the first of equals."""
    least = F.expr(f"array_min(transform(sequence(0, size(firsts) - 1), k -> struct({_SCORE} as score, k, firsts[k] as l, rests[k] as r)))")
    return candidates.withColumn("cut", least).select("lang", "phrase", "a", F.col("cut.l"), F.col("cut.r"), "n", F.col("cut.score"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    # a distinct word of a block takes several bytes of text
    blocks, path = settled_at(word_blocks(docs, lang_col, text_col, block_bytes, pieces(docs, 8 * BUCKET_KEYS, LEAST_BUCKETS)), "phrase-blocks")
    levels, totals, before = [], None, None
    for length in range(1, longest + 1):
        sums, sums_path = settled_at(summed(blocks, least, length == 1), "phrase-sums")
        names = sums.filter("id is not null")
        if length == 1:
            totals = settled(sums.filter("id is null and block is null").groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
            none = F.array().cast("array<long>")
            found = names.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("firsts"), none.alias("rests"))
        else:
            found = _phrases(names.select("id", "a", "b", "f"), levels[-1])
        levels.append(settled(found, "phrases"))
        done = [path, sums_path]
        if length == longest or levels[-1].isEmpty():
            removed(spark, *done)
            break
        # a block has no more pairs than places in its sequence
        size = blocks.agg(F.sum("size")).head()[0]
        now = max(LEAST_BUCKETS, -(-size // BUCKET_KEYS))
        (blocks, path), before = settled_at(pair_blocks(blocks, sums, before, now), "phrase-blocks"), now
        removed(spark, *done)  # the next length is all that they were for
    kept = []
    for i, found in enumerate(levels[1:], 1):
        if i + 1 < len(levels):  # a longer phrase that is as frequent has one of one word more in it that is, too
            longer = levels[i + 1]
            inside = longer.filter(F.element_at("firsts", -1) == F.col("f")).select(F.col("a").alias("id")).union(longer.filter(F.col("rests")[0] == F.col("f")).select(F.col("b").alias("id")))
            found = found.join(inside.distinct(), "id", "left_anti")
        kept.append(found.select("lang", "phrase", F.col("f").alias("a"), "firsts", "rests"))
    if not kept:
        kept = [levels[0].filter("false").select("lang", "phrase", F.col("f").alias("a"), "firsts", "rests")]
    candidates = kept[0]
    for more in itertools.islice(kept, 1, None):
        candidates = candidates.unionByName(more)
    best = _cut(skew_joined(candidates, totals, ["lang"], "n"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    some = best.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
