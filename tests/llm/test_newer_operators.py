"""Byte pairs, collocations and ball k-means against the library or brute force, with the awkward cases."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bifolio.llm import ball_kmeans, byte_pairs, phrase_mining
from bifolio.llm.queries import tokenizer_file

from .test_operators import ROWS, empty, got, table

BYTE_BPE = tokenizer_file("byte_bpe_50k.json")


# ---- 11


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


def texts():
    r = random.Random(11)
    some = ["a", "b", "the", " ", "  ", "\n", "'s", "'ll", "12", "!", "...", "é", "日", "\t", "zq", "<|endoftext|>", "<|", "x" * 60, "ab" * 40, " ", " ", "\x1c", "\x85", "　", "🙂"]
    return ["", " ", "  a", "a  ", "<|endoftext|>", "x<|endoftext|> y <|endoftext|><|endoftext|>  z", "aaaa" * 300, *["".join(r.choice(some) for _ in range(r.randrange(30))) for _ in range(3000)]]


def test_byte_pairs_equal_the_library(library):
    pairs, some = byte_pairs.BytePairs(BYTE_BPE), texts()
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert pairs.ordered and [np.frombuffer(x, "<u4").tolist() for x in pairs.encode(some)] == want
    assert [x.decode() for x in pairs.decode_all([np.array(x) for x in want])] == [library.decode(x, skip_special_tokens=False) for x in want] == some
    slow = byte_pairs.BytePairs(BYTE_BPE, remembered=2000)  # forgets all the time, and merges one by one
    slow.ordered = False
    for i in range(0, 600, 50):
        assert [np.frombuffer(x, "<u4").tolist() for x in slow.encode(some[i : i + 50])] == want[i : i + 50]
    ids = [random.Random(i).randrange(50257) for i in range(3000)]
    assert pairs.decode_all([np.array(ids)])[0].decode() == library.decode(ids, skip_special_tokens=False)
    assert pairs.decode_all([np.array([-1, 10**9])]) == [b""]


def test_every_character_is_split_as_the_library_does(library):
    pairs = byte_pairs.BytePairs(BYTE_BPE)
    some = [f"a{c}b1{c} {c}  {c}x!{c}?" for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000, 7)])]
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in pairs.encode(some)] == want


def test_cuts_are_certain(library):
    """No token of the vocabulary spans a cut, and cuts make fragments short."""
    pairs = byte_pairs.BytePairs(BYTE_BPE)
    raw = np.frombuffer("zq jvwxq hello".encode(), np.uint8)
    cuts = pairs.fragments(raw, np.array([0]))
    assert len(cuts) > 1 and not any(pairs.inside[raw[c - 1], raw[c]] for c in cuts[1:])
    for token in ("hello", "Ġthe", "ing"):
        b = np.frombuffer(token.replace("Ġ", " ").encode(), np.uint8)
        assert pairs.inside[b[:-1], b[1:]].all()


def test_byte_pairs_of_rows(spark, library):
    rows = [*ROWS, (7, "same"), (7, "same"), (None, "same"), (900, "long word" + "q" * 300_000 + " " * 300_000 + "9")]
    docs = table(spark, rows).repartition(3)
    want = []
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got(byte_pairs.round_trip(docs, BYTE_BPE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    coded = byte_pairs.encoded(docs, BYTE_BPE)
    assert coded.columns == ["doc_id", "n_tokens", "ids"]
    assert got(byte_pairs.decoded(coded, BYTE_BPE), "doc_id", "text") == sorted(((i, t or "") for i, t in rows), key=repr)
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert got(byte_pairs.decoded(none, BYTE_BPE), "doc_id", "text") == [(1, ""), (2, "")]
    assert byte_pairs.round_trip(empty(spark), BYTE_BPE).count() == 0


def test_long_words_take_about_linear_time():
    import time

    pairs = byte_pairs.BytePairs(BYTE_BPE)
    for word in ("a" * 200_000, "xyzzy" * 40_000, " " * 200_000, "9" * 200_000, "é" * 100_000):
        began = time.process_time()
        pairs.encode([word])
        assert time.process_time() - began < 5


# ---- 12


def split(text):
    import re

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^ \t]+", x) for x in re.split("[.,;:!?\n\x0b\x0c\r]", lowered)]


def brute_phrases(rows, least, longest, top):
    f, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for words in split(text):
            total[lang or "und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[("und" if lang is None else lang), tuple(words[i : i + k])] += 1
    out = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        score, _, l, r = min((1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        if any(g == lang and len(q) > len(p) and b >= least and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in f.items()):
            continue
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, total[lang], -score) for lang, found in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def phrase_rows():
    r = random.Random(12)
    vocabulary = ["New", "york", "times", "of", "the", "état", "日本", "z", "q r", "x" * 40]
    rows = [(r.choice(["en", "de", None, "und", ""]), "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x1c "]) for _ in range(r.randrange(60)))) for _ in range(120)]
    rows += [("en", "the same passage again and again"), ("en", None), (None, None), ("en", " .,; \n"), ("fr", "tout seul ici")] * 6
    rows += [("long", "a b " * 20_000), ("hot", "a b")] + [("hot", "a b c d e f")] * 200
    return rows


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("block_bytes, keys, longest, top", [(2000, 1 << 20, 5, 2000), (1 << 20, 50, 5, 7), (500, 1000, 3, 2000), (500, 1, 2, 3)])
def test_collocations(spark, monkeypatch, block_bytes, keys, longest, top):
    monkeypatch.setattr(phrase_mining, "BUCKET_KEYS", keys)
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, lang, 1, 2, "s", "w", "b") for lang, t in rows], "text string, lang string, n long, id long, seq string, word string, block string").repartition(5)
    monkeypatch.setattr("bifolio.llm.phrase_mining.bounded_batches", lambda spark: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20"))
    try:
        found = phrase_mining.collocations(docs, least=4, longest=longest, top=top, block_bytes=block_bytes)
        assert got(found, *COLUMNS) == sorted(brute_phrases(rows, 4, longest, top), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_collocations_without_any(spark):
    docs = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    for some in (docs, docs.filter("false"), docs.filter("text is null")):
        assert phrase_mining.collocations(some).collect() == []
    words = spark.createDataFrame([("en", "a. b. a. b")] * 60, "lang string, text string")
    assert phrase_mining.collocations(words).collect() == []


def test_counts_past_64_bits(spark):
    rows = [(1, "en", "a b", 10**15, [2 * 10**15], [3 * 10**15], 5 * 10**15), (2, "en", "c d", 10**12, [10**13], [10**13], 10**15)]
    found = phrase_mining._cut(spark.createDataFrame(rows, "id long, lang string, phrase string, a long, firsts array<long>, rests array<long>, n long")).collect()
    assert {r["phrase"]: r["score"] for r in found} == {"a b": 1000 * 10**15 * 5 * 10**15 // (6 * 10**30), "c d": 1000 * 10**12 * 10**15 // 10**26}


def test_sequences_round_trip():
    for x in (np.zeros(0, np.int64), np.array([-1, 5, 0, 70000, -1, 1 << 60])):
        assert [y.tolist() for y in phrase_mining.unpacked(phrase_mining.packed(x, x + 1))] == [x.tolist(), (x + 1).tolist()]


# ---- 13


def brute_kmeans(rows, k, rounds):
    v = []
    for i, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) and abs(64 * x) < ball_kmeans.LIMIT for x in e):
            v.append((i, [math.floor(64 * x) for x in e]))
    order = sorted(v, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids)) for _, x in v]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            members = [x for (_, x), (_, c) in zip(v, at, strict=True) if c == j]
            if members:
                centroids[j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    at = assign()
    inertia = [sum(d for d, c in at if c == j) for j in range(len(centroids))]
    return [(i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(v, at, strict=True)]


KEYS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def vectors(seed):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(64)] for _ in range(8)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in r.choice(centres)]) for i in range(300)]
    rows += [(400 + i, [r.choice([0.0, 1.0])] * 64) for i in range(60)]  # ties
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [(3, rows[3][1])] * 3 + [(3, [0.5] * 64), (None, [0.25] * 64), (None, [0.25] * 64)]
    rows += [(600, None), (601, []), (602, [1.0] * 63), (603, [1.0] * 65), (604, [None] + [1.0] * 63), (605, [float("nan")] * 64), (606, [float("inf")] + [0.0] * 63), (607, [1e300] * 64), (608, [-1e6] * 64)]
    return rows


@pytest.mark.parametrize("seed, k, rounds", [(0, 16, 3), (1, 5, 6), (2, 1, 2), (3, 16, 0), (4, 5000, 2)])
def test_ball_kmeans(spark, monkeypatch, seed, k, rounds):
    rows = vectors(seed) if k < 100 else vectors(seed)[:20]
    monkeypatch.setattr(ball_kmeans, "STEP", 50)
    table = spark.createDataFrame([(i, e, 1, 2, 3) for i, e in rows], "vec_id long, embedding array<double>, x int, cluster int, distance int").repartition(4)
    found = ball_kmeans.with_inertia(*ball_kmeans.clusters(table, k=k, rounds=rounds))
    assert got(found, *KEYS) == sorted(brute_kmeans(rows, k, rounds), key=repr)


def test_ball_kmeans_without_vectors(spark):
    for rows in ([], [(1, None), (2, [0.5])]):
        found = ball_kmeans.with_inertia(*ball_kmeans.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
        assert found.columns == list(KEYS) and found.collect() == []


def test_balls_save_distances():
    g = np.random.default_rng(13)
    centroids = g.integers(-1000, 1000, (16, 64))
    at = g.integers(0, 16, 4000)
    x = centroids[at] + g.integers(-20, 20, (4000, 64))
    best, distance, took = ball_kmeans.nearest(x, at.copy(), centroids)
    every = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all() and took == len(x)
    wrong = g.integers(0, 16, 4000)  # from wrong clusters on, all the same
    best, distance, took = ball_kmeans.nearest(x, wrong, centroids)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()
    close = centroids[:4] // 100
    y = close[g.integers(0, 4, 4000)] + g.integers(-30, 30, (4000, 64))
    every = ((y[:, None, :] - close[None]) ** 2).sum(2)
    best, distance, took = ball_kmeans.nearest(y, np.zeros(4000, np.int64), close)
    assert (best == every.argmin(1)).all() and (distance == every.min(1)).all() and took <= 4 * len(y)


# ---- the shared folder


def test_temporary_files_belong_to_their_block(spark):
    from bifolio.llm import common

    before = common.settled(spark.range(3), "kept")
    with common.temporary(spark) as outer:
        own = common.settled(spark.range(4), "outer")
        with common.temporary(spark) as inner:
            common.settled(spark.range(5), "inner")
        assert own.count() == 4 and len(outer) == 1 and len(inner) == 1
        with pytest.raises(Exception):
            spark.read.parquet(inner[0]).count()
    assert before.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(outer[0]).count()


def test_results_outlive_a_pipeline_run(spark):
    """A DataFrame that an operator gave before can still be read after a run, and what the run returns, too."""
    import corpus_pipeline
    from bifolio.llm import queries

    sf = "/root/testdata/sf0.001"
    records = queries.op2_token_records(spark, sf)
    phrases = queries.op12_collocations(spark, sf)
    docs = corpus_pipeline.run(spark, sf)
    assert docs.count() and records.count() and phrases.count() >= 0


# ---- languages without a bound


def test_all_languages_are_learnt(spark, monkeypatch):
    from bifolio.llm import language_id

    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    rows = [(i, " ".join(f"{w}{'etnosi'[k % 6]}{w}" for k in range(30)), f"l{i:03d}") for i, w in enumerate(words) for _ in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.fit(docs, F.lit(True))) == 150
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 1)
    assert len(language_id.fit(docs, F.lit(True))) == 150


# ---- records read in stretches


def test_records_are_read_in_stretches(spark, tmp_path, monkeypatch):
    """Bounded reads give the same rows, with ids of any value, none, long records and repeated ones."""
    from tokenizers import Tokenizer

    from bifolio.llm import token_records

    library = Tokenizer.from_file(BYTE_BPE)
    rows = [(-(1 << 63), "least id"), (None, "no id"), (0, "zero"), ((1 << 63) - 1, "largest"), (5, "word " * 3000), (6, None), (7, ""), (7, ""), *[(100 + i, f"text {i} of some") for i in range(60)]]
    want = sorted(((i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    manifest = token_records.write_records(table(spark, rows), BYTE_BPE, f"file://{tmp_path}/records", least_files=2)
    monkeypatch.setattr(token_records, "READ_ENTRIES", 7)
    monkeypatch.setattr(token_records, "READ_BYTES", 200)
    for m in manifest:  # here, as workers have bounds of their own
        kind, whole = np.dtype("<u2"), open(m["records"].removeprefix("file://"), "rb").read()
        pieces = list(token_records._stretches(m["records"], m["index"], kind))
        assert len(pieces) > 3 and b"".join(bytes(data) for _, data, _ in pieces) == whole and sum(len(index) for index, _, _ in pieces) == m["n_docs"]
        longest = max(2 * int(n & ~token_records.NO_ID) + token_records.FRAME_BYTES for index, _, _ in pieces for n in index["n"])
        assert all(base == int(index["offset"][0]) and len(data) <= 200 + longest for index, data, base in pieces)
    back = token_records.read_records(spark, manifest).orderBy("start").collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in back), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) == want
    starts = np.cumsum([0, *[len(r["ids"]) for r in back]])
    assert [r["start"] for r in back] == starts[:-1].tolist() and [r["doc_id"] for r in back if r["doc_id"] is not None] == sorted(i for i, _ in rows if i is not None)
    mixed = token_records.read_shuffled(spark, manifest, seed=3).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in mixed), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) == want
