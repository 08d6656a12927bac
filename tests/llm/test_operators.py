"""Each operator against brute force on small tables with the awkward cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bifolio.llm import common, decontaminate, exact_dedup, filters, jaccard_join, language_id, pii, quality, sentence_pieces, substring_dedup, token_records, toxicity
from bifolio.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, kept string, digest string, n long, spans string, m long, x string, label string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "k", "d", 7, "s", 1, "x", "l") for i, t in rows], SCHEMA)


def some_texts(seed=0, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "ñ", "IDIOT", "a@b.co"]
    base = [r.choice(vocabulary) for _ in range(300)]
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.3 and out:
            words = (r.choice(out) or "").split(" ")
            for _ in range(r.choice([0, 0, 1, 2])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append(" ".join(words))
        elif kind < 0.5:
            a = r.randrange(250)
            out.append(" ".join([r.choice(vocabulary) for _ in range(5)] + base[a : a + r.randrange(5, 50)] + [r.choice(vocabulary) for _ in range(5)]))
        else:
            out.append(r.choice([" ", "  ", "\n", " \t"]).join(r.choice(vocabulary) for _ in range(r.randrange(0, 80))))
    return out


ROWS = [*enumerate(some_texts()), (100, None), (101, ""), (102, " \n\t "), (103, "x"), (104, "x"), (105, "one two"), (106, "same " * 3000), (107, "same " * 2999 + "other"), (None, "x"), (None, None), (108, "q" * 50_000), (50, None)]
ROWS = [x for x in ROWS if x[0] != 50 or x[1] is None]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS).repartition(3)


def empty(spark):
    return table(spark, [])


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# ---- 1


def brute_contamination(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[a : a + n])].add(i)
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_contamination(spark):
    """Also rows without an id, with a repeated one, and repeated rows."""
    rows = [*ROWS, (5, ROWS[3][1]), (5, "clean words"), (None, ROWS[5][1]), ROWS[3], (None, ROWS[3][1])]
    items = [(1, ROWS[3][1]), (2, ROWS[5][1]), (2, ROWS[5][1]), (10, "w1 w2"), (11, None), (12, ""), (13, "..."), (14, "same " * 30), (None, "W3 w4 w5"), (9, "ÉTÉ x")]
    benchmark = spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, item string")
    docs = table(spark, rows).repartition(3)
    want = brute_contamination(rows, items)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(decontaminate.contamination(docs, benchmark), *names) == want
    few = decontaminate.BROADCAST_WINDOWS
    decontaminate.BROADCAST_WINDOWS = 0  # the way without broadcasts
    try:
        assert got(decontaminate.contamination(docs, benchmark), *names) == want
    finally:
        decontaminate.BROADCAST_WINDOWS = few


def test_sliding_least(spark):
    r = random.Random(1)
    lists = [[r.randrange(9) for _ in range(n)] for n in (0, 1, 2, 5, 7, 30)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    for wide in (1, 2, 3, 7):
        found = [r[0] for r in df.select(decontaminate.sliding_least(F.col("x"), wide, lambda m: m)).collect()]
        assert found == [[min(x[i : i + wide]) for i in range(len(x))] for x in lists]


def test_contamination_without_rows(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.contamination(docs, none).collect()} == {0}
    assert decontaminate.contamination(empty(spark), none).count() == 0


# ---- 2


def test_token_records(spark, docs):
    """Also rows without an id and repeated ones; ids are in order, and each row starts where the ones before end."""
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [*ROWS, ROWS[4], (4, "other"), (None, "third")]
    want = []
    for d, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, len(ids), zlib.crc32(ids.tobytes())))
    found = token_records.token_records(table(spark, rows).repartition(3), path).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found), key=repr) == sorted(want, key=repr)
    found.sort(key=lambda r: r["start"])
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in found] == sorted(-1 if d is None else d for d, _ in rows)
    assert [r["start"] for r in found] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in found])))[:-1].tolist()
    assert token_records.token_records(empty(spark), path).count() == 0


def test_shuffled_reads(spark, docs, tmp_path):
    path = tokenizer_file("byte_bpe_50k.json")
    manifest = token_records.write_records(docs, path, f"file://{tmp_path}/records")
    plain = sorted((repr(r["doc_id"]), r["ids"]) for r in token_records.read_records(spark, manifest).collect())
    orders = []
    for seed in (1, 1, 2):
        got_rows = [(repr(r["doc_id"]), r["ids"]) for r in token_records.read_shuffled(spark, manifest, seed, 2).collect()]
        assert sorted(got_rows) == plain
        orders.append([d for d, _ in got_rows])
    assert orders[0] == orders[1] != orders[2]


def test_stretches_follow_each_other():
    encode = token_records.ChunkEncoder(tokenizer_file("byte_bpe_50k.json"), most=10_000)
    r = random.Random(1)
    for _ in range(400):
        t = "".join(r.choice("ab  \n\tÉ日1.,'s  xyz ") for _ in range(r.randrange(40)))
        assert encode([t])[0] == np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_records_show_damage():
    record = token_records.framed(b"abcdef")
    assert token_records.unframed(memoryview(record + b"x"), 0) == (b"abcdef", len(record))
    for i in range(len(record)):
        broken = bytearray(record)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            token_records.unframed(memoryview(bytes(broken)), 0)


# ---- 3


def test_quality(spark):
    r = random.Random(2)
    good = [" ".join(r.choice(["the", "of", "Paper", "reads,", "well."]) + str(r.randrange(9)) for _ in range(40)) for _ in range(60)]
    bad = [" ".join(["BUY!!", "NOW!!"] * r.randrange(5, 30)) for _ in range(60)]
    rows = [*enumerate(good + bad), (500, None), (501, ""), (None, "x")]
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["score"] for r in quality.quality_scores(table(spark, rows), labels, learn=lambda i: F.lit(True)).collect()}
    assert len(found) == len(rows) and all(0 <= s <= 1 for s in found.values())
    assert np.mean([(found[i] >= 0.3) == (i < 60) for i in range(1, 120, 2)]) > 0.95
    none = labels.filter("doc_id < 0")
    assert {r["score"] for r in quality.quality_scores(table(spark, rows), none, learn=lambda i: F.lit(True)).collect()} == {0.5}
    assert quality.quality_scores(empty(spark), labels, learn=lambda i: F.lit(True)).count() == 0


def test_equations_equal_a_dense_solve(spark):
    """The sums over partitions give the weights of one dense ridge regression, with ties and rows of contradicting labels."""
    g = np.random.default_rng(4)
    k = len(quality.STATISTICS)
    x = g.standard_normal((300, k)) * np.arange(1, k + 1)
    x[40:50] = x[30]  # equal rows, with both labels
    y = (x[:, 0] + 0.3 * g.standard_normal(300) > 0).astype(int)
    y[40:45], y[45:50] = 0, 1
    half = g.integers(0, 2, 300)
    rows = spark.createDataFrame([(v.tolist(), int(t), int(h)) for v, t, h in zip(x, y, half, strict=True)], "x array<double>, y int, half int").repartition(20)
    model = quality.fit(rows, waves=32)
    z = model.features(x)
    penalty = np.full(z.shape[1], 3.0)
    penalty[-1] = 1e-6
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y), atol=1e-8)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-3)
    raw = np.empty(300)
    for h in (0, 1):
        a, own = z[half != h], half == h
        raw[own] = z[own] @ np.linalg.solve(a.T @ a + np.diag(penalty), a.T @ y[half != h])
    b = np.clip(((raw - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS).astype(int), 0, quality.BINS - 1)
    assert np.allclose(model.steps, quality.isotonic(np.bincount(b, minlength=quality.BINS).astype(float), np.bincount(b, y, quality.BINS)))
    alone = quality.fit(rows.withColumn("half", F.col("y")), waves=32)  # each half has one label only: the common equations score both
    place = np.clip(((z @ model.weights - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS).astype(int), 0, quality.BINS - 1)
    assert np.allclose(alone.steps, quality.isotonic(np.bincount(place, minlength=quality.BINS).astype(float), np.bincount(place, y, quality.BINS)))


@pytest.mark.parametrize("repeated", [0, 1])
def test_quality_of_repeated_labelled_texts(spark, repeated):
    """One text many times in one label, few or many others: scores of separable labels lie on their own sides."""
    good = [f"The paper number {i} reads well, and its words differ from line to line." for i in range(40)]
    bad = [f"BUY!! NOW!! {i} " * 20 for i in range(40)]
    texts = [*(good[:1] * 100 if repeated else good), *(bad if repeated else bad[:1] * 100)]
    first = 100 if repeated else 40
    labels = spark.createDataFrame([(i, int(i < first), 0) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["score"] for r in quality.quality_scores(table(spark, enumerate(texts)), labels, learn=lambda i: F.lit(True)).collect()}
    assert all((found[i] >= 0.5) == (i < first) for i in found)


def test_quality_of_the_tables(spark):
    """Held-out labels of the tables; long, empty and repeated texts."""
    from bifolio.llm.common import crc_mod

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs.withColumn("score", F.lit("x")), labels.withColumn("x", F.lit(1)), learn=lambda i: crc_mod(i, 5) != 0).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["quality"] is not None and r["doc_id"] in found]
    assert np.mean([(found[r["doc_id"]] >= 0.3) == (r["quality"] == 1) for r in held]) > 0.95
    rows = quality.with_statistics(table(spark, [(1, "word " * 400_000), (2, ""), (3, None), (4, "a b"), (4, "a b")])).collect()
    by_id = {r["doc_id"]: r["x"] for r in rows}
    assert len(rows) == 5 and by_id[2] == by_id[3] == [0.0] * len(quality.STATISTICS) and all(np.isfinite(r["x"]).all() for r in rows)


def test_isotonic_is_monotone_and_keeps_the_sum():
    r = np.random.default_rng(0)
    w = r.integers(0, 5, 100).astype(float)
    p = np.minimum(w, r.integers(0, 5, 100))
    s = quality.isotonic(w, p)
    assert (np.diff(s) >= -1e-12).all() and abs(s @ w - p.sum()) < 1e-9


# ---- 4


def brute_dedup(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    return {t: (max((d for d in g if d is not None), default=None), len(g)) for t, g in groups.items()}


@pytest.mark.parametrize("bytes_kept", [32, 1])
def test_exact_dedup(spark, docs, bytes_kept):
    """With digests of one byte, most entries are hit by other texts."""

    def digest(c):
        return F.substring(exact_dedup.sha256(c), 1, bytes_kept)

    rows = [*ROWS, ROWS[1], ROWS[1]]
    want = brute_dedup(rows)
    found = exact_dedup.exact_dedup(table(spark, rows).repartition(3), digest=digest).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in found if r["doc_id"] is not None) == sorted((d, *want[t or ""]) for d, t in rows if d is not None)
    assert sum(r["kept"] for r in found) == len(want)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_many_digests(spark, monkeypatch):
    """The way without broadcasts, and with hot digests."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    rows = [*ROWS, *[(1000 + i, "x") for i in range(20)]]
    want = brute_dedup(rows)
    found = exact_dedup.exact_dedup(table(spark, rows).repartition(3), digest=lambda c: F.substring(exact_dedup.sha256(c), 1, 2)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in found), key=repr) == sorted(((d, *want[t or ""]) for d, t in rows), key=repr)
    assert sum(r["kept"] for r in found) == len(want)


def test_locators_are_opened(spark, tmp_path):
    """An entry's text is what lies at its locator."""
    table(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "c")]).coalesce(1).write.parquet(f"{tmp_path}/d")
    texts = exact_dedup.texts_at(spark.read.parquet(f"{tmp_path}/d"))
    groups = exact_dedup.keyed_state(exact_dedup.state_rows(texts))
    assert sorted(r["entry_text"] for r in exact_dedup.opened(texts, groups).collect()) == ["a", "b", "c"]
    wrong = groups.withColumn("entry", F.struct("entry.doc_id", "entry.file", F.lit(1).cast("long").alias("row")))
    assert {r["entry_text"] for r in exact_dedup.opened(texts, wrong).collect()} == {"b"}
    bad = exact_dedup.clashes(texts, exact_dedup.state_rows(texts), wrong, exact_dedup.sha256)
    assert bad is not None and bad.count() == 1  # the two copies of "a" differ from what their entry leads to


def test_state_goes_on(spark, tmp_path):
    first, second = table(spark, [(1, "a"), (2, "b")]), table(spark, [(3, "a"), (4, None)])
    staged = f"file://{tmp_path}/rows"
    for part in (first, second):
        rows = exact_dedup.state_rows(exact_dedup.texts_at(part))
        rows.write.mode("append").parquet(staged)
        exact_dedup.run_stream(spark, staged, rows.schema, f"file://{tmp_path}/state")
    state = exact_dedup.state_table(spark, f"file://{tmp_path}/state")
    assert sorted((r["entry"]["doc_id"], r["group_size"]) for r in state.collect()) == [(2, 1), (3, 2), (4, 1)]


@pytest.mark.parametrize("bytes_kept", [1, 32])
@pytest.mark.parametrize("from_files", [True, False])
def test_dedup_goes_on(spark, tmp_path, bytes_kept, from_files):
    """Later runs compare bytes with texts of earlier ones, also where a digest of one byte makes many texts clash: each run's rows equal brute force over all rows so far."""
    r = random.Random(bytes_kept)
    every, at = [], f"file://{tmp_path}/state"
    for run in range(3):
        rows = [(run * 100 + i if r.random() < 0.9 else None, r.choice([None, "", *[f"text {r.randrange(60)}"] * 5])) for i in range(40)]
        part = table(spark, rows).repartition(2)
        if from_files:
            part.write.parquet(f"file://{tmp_path}/in-{run}")
            part = spark.read.parquet(f"file://{tmp_path}/in-{run}")
        found = exact_dedup.exact_dedup(part, digest=lambda c: F.substring(exact_dedup.sha256(c), 1, bytes_kept), checkpoint=at).collect()
        every += rows
        groups = collections.defaultdict(list)
        for i, t in every:
            groups[t or ""].append(i)
        best = {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
        texts = {i: t or "" for i, t in rows if i is not None}
        named = [x for x in found if x["doc_id"] is not None]
        assert len(found) == len(rows) and len(named) == len(texts)
        for x in named:
            keep, size = best[texts[x["doc_id"]]]
            assert (x["keep_id"], x["group_size"], x["kept"]) == (keep, size, keep == x["doc_id"]), x
        nameless = sorted((best[t or ""] for i, t in rows if i is None), key=repr)
        assert sorted(((x["keep_id"], x["group_size"]) for x in found if x["doc_id"] is None), key=repr) == nameless


# ---- 5


def brute_repeats(rows):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))]
    seen, out = set(), []
    for d, w in split:
        gone = set()
        for a in range(len(w) - 19):
            g = tuple(w[a : a + 20])
            if g in seen:
                gone.update(range(a, a + 20))
            seen.add(g)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(spark):
    rows = [*ROWS, ROWS[2], (200, "y " * 25), (201, " ".join(map(str, range(60)))), (202, " ".join(map(str, range(7, 41)))), (203, " ".join(map(str, range(30, 49))))]
    found = substring_dedup.remove_repeats(table(spark, rows).repartition(4))
    assert got(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows)
    texts = {r["doc_id"]: r["text"] for r in substring_dedup.kept_texts(table(spark, rows)).collect()}
    assert texts[202] == "" and texts[203] == " ".join(map(str, range(30, 49)))
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_cover_has_all_differences():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


# ---- 6


def brute_jaccard(rows):
    """(id, shingles, least id of the component) of every row, also of those without an id."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 90 * (len(sets[i]) + len(sets[j]) - n):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near_rows(seed=5):
    r = random.Random(seed)
    rows, base = [], [[f"v{r.randrange(500)}" for _ in range(n)] for n in (4, 9, 12, 14, 22, 23, 40, 120, 300)]
    for i in range(220):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = f"e{r.randrange(3000)}"
        if r.random() < 0.3:
            w = w[: r.randrange(1, len(w) + 1)]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("chunk", [2048, 7])
def test_jaccard_join(spark, chunk, monkeypatch):
    """Also with so small chunks that components are cut."""
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", chunk)
    if chunk < 100:
        monkeypatch.setattr(jaccard_join, "BROADCAST_UNITS", 0)
        monkeypatch.setattr(jaccard_join, "FAN_OUT", 3)
    near = near_rows()
    # rows without an id: some link others together, some are alone, some are copies; an id of two texts
    nameless = [(None if i % 5 == 0 else i, t) for i, t in near]
    rows = [*[x for x in ROWS if x[0] is None or x[0] >= 100], *nameless, (11, near[11][1]), (12, "quite another text than that of twelve"), (None, "alone in all the corpus"), (None, near[0][1])]
    found = jaccard_join.jaccard_components(table(spark, rows).repartition(4))
    assert got(found, "doc_id", "n_shingles", "component_id") == brute_jaccard(rows)


def test_jaccard_edges(spark, docs):
    assert jaccard_join.jaccard_components(docs).count() == len(ROWS)
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


def test_sketches_lose_no_pair():
    r = np.random.default_rng(3)
    sets = []
    for n in (1, 3, 10, 64, 65, 300, 1000):
        base = r.integers(0, 1 << 62, n).astype(np.uint64)
        for k in range(4):
            some = base[: max(1, n - k * n // 12)].copy()
            some[: k * len(some) // 15] = r.integers(0, 1 << 62, k * len(some) // 15)
            sets.append(np.unique(some))
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    size = np.diff(offsets)
    found = jaccard_join.sketches(np.concatenate(sets), offsets)
    for percent in (80, 90):
        roots = jaccard_join.near_sketches(found, size, percent)
        for i in range(len(sets)):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= percent * (size[i] + size[j] - n):
                    assert roots[i] == roots[j]
        assert len(set(roots.tolist())) >= 6


def test_packets():
    r = np.random.default_rng(1)
    for n, k in ((1, 1), (50, 7), (200_000, 70_000)):
        entries, keys = np.sort(r.integers(0, 1 << 48, n)).astype(np.uint64), r.integers(0, 1 << 63, k).astype(np.uint64)[r.integers(0, k, n)]
        a, b = jaccard_join.unpacked(jaccard_join.packed(entries, keys))
        assert np.array_equal(a, entries) and np.array_equal(b, keys)


def test_packets_grow_with_the_input(spark, monkeypatch):
    """Twice the stretches and twice the buckets: no more than about twice the packets, and the same entries in each bucket."""
    monkeypatch.setattr(jaccard_join, "FAN_OUT", 4)
    r = np.random.default_rng(6)

    def dealt(stretches, buckets):
        widths = [1]
        while -(-buckets // widths[0]) > 4:
            widths.insert(0, widths[0] * 4)
        data = [(np.sort(r.integers(0, 1 << 47, 400, dtype=np.uint64) << np.uint64(1)), r.integers(0, 1 << 62, 400).astype(np.uint64)) for _ in range(stretches)]
        rows = [tuple(x.values()) for e, k in data for x in jaccard_join.packets(e, k, buckets, widths[0]).to_pylist()]
        found = jaccard_join.in_buckets(spark.createDataFrame(rows, jaccard_join.PACKET).repartition(3), buckets, widths).collect()
        back = [(e, k, row["bucket"]) for row in found for e, k in zip(*map(np.ndarray.tolist, jaccard_join.unpacked(row["entries"])), strict=True)]
        assert sorted((e, k) for e, k, _ in back) == sorted((e, k) for x in data for e, k in zip(*map(np.ndarray.tolist, x), strict=True))
        assert all(((e >> 16) * buckets) >> 32 == b for e, _, b in back)
        return len(rows), len(found)

    a, b = dealt(20, 40), dealt(40, 80)
    assert b[0] <= 2.5 * a[0] and b[1] <= 2.5 * a[1]


def test_ranges_lose_no_entry():
    r = np.random.default_rng(2)
    parts = [(np.sort(r.integers(0, 1 << 48, n)).astype(np.uint64), r.integers(0, 9, n).astype(np.uint64)) for n in (1, 40, 500)]
    for each in (1, 30, 10_000):
        got_all = list(jaccard_join.by_range(parts, each))
        assert sorted(x for e, k in got_all for x in zip(e.tolist(), k.tolist(), strict=True)) == sorted(x for e, k in parts for x in zip(e.tolist(), k.tolist(), strict=True))
        seen = [{x | 1 for x in e.tolist()} for e, _ in got_all]
        assert sum(map(len, seen)) == len(set().union(*seen))


def test_allocation_keeps_the_guarantee():
    for low, high in ((1, 1), (5, 9), (10, 11), (90, 99), (900, 1000)):
        most, ones, twos, spare = jaccard_join.allocation(low, high, 90)
        assert ones + 2 * twos == most + 1 + spare
        largest = high * 100 // 90
        assert most >= max((s + high - 2 * -(-90 * (s + high) // 190)) for s in range(high, largest + 1))


# ---- 7


def test_language(spark):
    r = random.Random(3)
    words = {"en": "the and with from this that house water over".split(), "fr": "les des une avec pour dans maison être déjà".split()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(["en", "fr"] * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "", "en"), (902, "123 !!", "fr"), (None, "les des", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.col("doc_id") % 2 < 2)
    found = {x["doc_id"]: x for x in language_id.identify(docs, model).collect()}
    assert all(found[i]["lang_pred"] == k for i, _, k in rows)
    assert {found[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and len(found) == len(rows) + 4
    assert language_id.fit(docs.filter("doc_id < 0"), F.lit(True)) == {}
    assert {x["lang_pred"] for x in language_id.identify(docs, {}).collect()} == {"und"}


def test_language_of_the_tables(spark):
    """Held-out labels of the tables, and the same choice by a plain loop with compressors of its own."""
    import zstandard as z

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs, common.crc_mod(F.col("doc_id"), 3) != 1)
    rows = docs.withColumn("lang_pred", F.lit("zz")).withColumn("rejected", F.lit("clash"))
    found = {r["doc_id"]: r for r in language_id.identify(rows, model).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["lang"]]
    assert np.mean([found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.95
    how = dict(window_log=20, hash_log=17, chain_log=17, search_log=1, min_match=4, strategy=z.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    for r in held[:40]:
        sizes = []
        for lang, content in sorted(model.items()):
            squeeze = z.ZstdCompressor(compression_params=z.ZstdCompressionParameters(**how), dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT))
            sizes.append((len(squeeze.compress(re.sub(r"[\W\d_]+", " ", r["text"].lower()).encode())), lang))
        assert min(sizes)[1] == found[r["doc_id"]]["lang_pred"]


def test_language_edges(spark):
    """Signs that look like letters aren't, long texts serve whole or not at all, languages are bounded, repeated rows are equal."""
    rows = [(1, "²³ ½ ①", "en"), (2, "the house and the garden " * 5, "en"), (3, "la maison et le jardin " * 2000, "fr"), (4, "das haus und der garten " * 5, "de"), (5, None, None), (5, "the house", None), (5, "the house", None), (None, "le jardin " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True))
    assert sorted(model) == ["de", "en", "fr"] and model["fr"].count(b"jardin") == 2000
    found = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs, model).collect()]
    assert sorted(found, key=repr) == sorted([(1, "und"), (2, "en"), (3, "fr"), (4, "de"), (5, "und"), (5, "en"), (5, "en"), (None, "fr")], key=repr)
    assert sorted(language_id.fit(docs, F.lit(True), languages=2)) == ["de", "en"]
    assert language_id.identify(docs.limit(0), model).count() == 0


# ---- 8


def test_nearest_is_exact():
    r = random.Random(4)
    vocabulary = [f"word{c}" for c in "abcdefghijklmnopqrst"]
    texts = [" ".join(r.choice(vocabulary[:10] if i % 2 else vocabulary[5:]) for _ in range(r.randrange(1, 30))) for i in range(300)]
    index = toxicity.build(list(range(300)), texts, [i % 2 for i in range(300)])
    # by brute force: dense vectors of all terms
    split = [re.findall("[a-z]+", t) for t in texts]
    words = sorted({w for t in split for w in t})
    n, y = len(texts), np.arange(300) % 2
    count = np.array([[t.count(w) for w in words] for t in split], float)
    df = (count > 0).sum(0)
    phi2 = np.array([np.corrcoef(count[:, j] > 0, y)[0, 1] ** 2 if 0 < df[j] < n else 0 for j in range(len(words))])
    dense = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0) * np.log(1 + n / df) * phi2
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
    assert len(index.vocabulary) == len(words) == 20
    searched = 0
    for i in range(n):
        t, w = index.vector(toxicity.bags(toxicity.pa.array([texts[i]]))[0])
        searched += int((index.begin[index.first[t + 1]] - index.begin[index.first[t]]).sum())
        found, cos = index.nearest(t, w)
        want = dense @ dense[i]
        order = np.lexsort((np.arange(n), -np.round(want, 9)))[: len(found)]
        assert np.allclose(cos, want[order]) and index.ids[found].tolist() == order.tolist()
        # votes, score and evidence
        vote = (want[order] ** 2 * y[order]).sum() / (want[order] ** 2).sum()
        score, evidence = index.score(t, w)
        assert evidence == order.tolist() and score == index.cells[min(7, int(vote * 8 + 1e-9)), min(3, int(want[order][0] * 4 + 1e-9))]
    assert index.read < searched * 2  # each search ran twice


def test_search_reads_few_postings():
    r = random.Random(5)
    texts = [" ".join([f"topic{'abcdefgh'[i % 8]}"] * 5 + [r.choice(["aa", "bb", "cc", "dd"]) for _ in range(5)]) for i in range(2000)]
    index = toxicity.build(list(range(2000)), texts, [int(i % 8 < 3) for i in range(2000)])
    whole = 0
    for x in toxicity.bags(toxicity.pa.array(texts[:200])):
        t, w = index.vector(x)
        whole += int((index.begin[index.first[t + 1]] - index.begin[index.first[t]]).sum())
        index.nearest(t, w)
    assert index.read < whole / 2


def test_clashing_labels(spark):
    docs = table(spark, [(i, f"word{'ab'[i % 2]}") for i in range(40)])
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 0), (2, 1), (2, 0), (3, 1), (3, None), (4, 7), (None, 1)], "doc_id long, toxic int")
    ids, _, y, counts = toxicity.examples(docs, labels, learn=lambda i: F.lit(True))
    assert dict(zip(ids, y, strict=True)) == {1: 0, 2: 1, 3: 1} and counts == {0: 1, 1: 2}


def test_toxicity(spark):
    r = random.Random(6)
    rows = [(i, " ".join([r.choice(["fine", "day", "walk", "tree"]) for _ in range(20)] + ["nasty", "Vile"][: 2 * (i % 3 == 0)])) for i in range(150)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int")
    docs = table(spark, [*rows, (800, None), (801, ""), (None, "vile")])
    index = toxicity.build(*toxicity.examples(docs, labels, learn=lambda i: F.lit(True)))
    found = {x["doc_id"]: x for x in toxicity.toxicity_scores(docs, index).collect()}
    assert all((found[i]["score"] >= 0.7) == (i % 3 == 0) for i in range(150)) and found[3]["evidence"]
    assert all(0 <= x["score"] <= 1 for x in found.values())
    nothing = toxicity.build([], [], [])
    assert {x["score"] for x in toxicity.toxicity_scores(docs, nothing).collect()} == {0.5}
    assert toxicity.toxicity_scores(empty(spark), index).count() == 0


# ---- 9


def brute_base(text):
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= sum(c.isdigit() for c in m[0]) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))]
    found += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_base_spans():
    r = random.Random(8)
    for _ in range(3000):
        t = "".join(r.choice(["a", "@", ".", "-", " ", "1", "25", "+", "(", ")", "0", "é", "x.co", "4111 1111 1111 1111"]) for _ in range(r.randrange(25)))
        assert pii.base_spans(t) == brute_base(t), t


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("mail jane.doe (at) example (dot) com now", "email", "jane.doe (at) example (dot) com"),
        ("write to jane at mail dot example dot org", "email", "jane at mail dot example dot org"),
        ("éé ｊane＠exаmple．com", "email", "ｊane＠exаmple．com"),
        ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("call plus four nine one seven one five five five one two", "phone", "plus four nine one seven one five five five one two"),
        ("１９２.１６８.0.1", "ip", "１９２.１６８.0.1"),
    ],
)
def test_disguises(text, kind, part):
    base, every = pii.spans(text)
    a = text.index(part)
    assert base == [] and pii.listed(every) == f"{kind}:{a}:{a + len(part)}"


def test_ordinary_words_stay():
    for t in ["meet me at noon on the dot", "one two three", "un deux trois quatre", "the point at issue", "(at) (dot)", "a​b"]:
        assert pii.spans(t)[1] == []


def test_pii(spark, docs):
    found = {r["doc_id"]: r for r in pii.find_pii(docs.filter("doc_id is not null")).collect()}
    for d, t in ROWS:
        if d is not None:
            assert found[d]["base_sha256"] == hashlib.sha256(pii.listed(brute_base(t or "")).encode()).hexdigest()
            assert found[d]["n_email"] == found[d]["spans"].count("email:")
    assert pii.find_pii(empty(spark)).count() == 0


# ---- 10


def test_pieces_equal_the_library():
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.Pieces(path)
    r = random.Random(9)
    texts = [t or "" for _, t in ROWS if len(t or "") < 20_000] + ["".join(r.choice("aAeltinsr  ▁\n\té日x,.'01🦙  ") for _ in range(r.randrange(30))) for _ in range(800)]
    for t, x in zip(texts, own.encode(texts), strict=True):
        ids = np.frombuffer(x, "<u4").tolist()
        assert ids == library.encode(t), t
        assert own.decode(ids) == t.replace("▁", " ")


def test_pairs_are_judged_by_the_merges_that_made_their_pieces(monkeypatch):
    """As many runs of the merges as pieces, not as pairs; and pairs, also with pieces whose merges get better in turn, stay as they do by the merges."""
    path, r = tokenizer_file("piece_bpe_32k.model"), random.Random(10)
    own, merged, runs = sentence_pieces.Pieces(path), sentence_pieces.Pieces.merged, []
    monkeypatch.setattr(sentence_pieces.Pieces, "merged", lambda self, *a: runs.append(1) or merged(self, *a))
    own.encode([" ".join("".join(r.choice(["th", "er", "on", "ti", "e", "an", "s"]) for _ in range(r.randrange(2, 7))) for _ in range(20_000))])
    judged = [(int(x) // len(own.text), int(x) % len(own.text)) for x in own.pair_keys if x >= 0]
    assert len(judged) > 5_000 and len(runs) < 3_000
    for pieces, pairs in ((own, judged[:3_000]), (sentence_pieces.Pieces(path), None)):
        if not pairs:  # other scores, ties among them
            short = [i for i, p in enumerate(pieces.text) if 1 <= len(p) <= 5 and set(p) <= set("thernoisa")]
            pieces.score.update({pieces.text[i]: -float(r.randrange(len(short) // 2)) for i in short})
            pairs = [(r.choice(short), r.choice(short)) for _ in range(20_000)]
        one, two = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        want = [merged(pieces, pieces.text[a] + pieces.text[b]) == [pieces.text[a], pieces.text[b]] for a, b in pairs]
        assert pieces.stay(one, two).tolist() == want and len(set(want)) == 2


def test_unigram_finds_the_largest_sum():
    path = tokenizer_file("piece_bpe_32k.model")
    own = sentence_pieces.Pieces(path, kind=sentence_pieces.UNIGRAM)
    for word in ["▁reading", "▁Elle", "▁translation", "▁x"]:
        best = {0: 0.0}
        for e in range(1, len(word) + 1):
            best[e] = max((best[s] + own.score[word[s:e]] for s in range(e) if word[s:e] in own.score), default=-np.inf)
        (ids,) = own.viterbi([word])
        assert sum(own.score[own.text[i]] for i in ids) == best[len(word)]


def test_round_trip(spark, docs):
    path = tokenizer_file("piece_bpe_32k.model")
    want = {d: t or "" for d, t in ROWS if d is not None}
    rows = sentence_pieces.encoded(docs.filter("doc_id is not null"), path)
    assert {r["doc_id"]: r["text"] for r in sentence_pieces.decoded(rows, path).collect()} == want
    found = sentence_pieces.round_trip(docs.filter("doc_id is not null"), path).collect()
    assert all(r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest() for r in found)
    assert sentence_pieces.encoded(empty(spark), path).count() == 0


def test_long_runs_of_spaces():
    import time

    own = sentence_pieces.Pieces(tokenizer_file("piece_bpe_32k.model"))
    began = time.time()
    (x,) = own.encode([" " * 200_000])
    assert time.time() - began < 3 and own.decode(np.frombuffer(x, "<u4").tolist()) == " " * 200_000


# ---- as filters


def test_filters(spark, docs):
    rows = [*ROWS, ROWS[1], ROWS[1]]
    left = filters.distinct_documents(table(spark, rows).repartition(3))
    assert left.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    want = brute_dedup(rows)
    assert len(kept) == len(want) and {(d, t or "") for d, t in kept} == {(v[0], t) for t, v in want.items()}
    near = filters.one_of_each_group(docs.filter("doc_id is not null"))
    ids = {d for d, _, c in brute_jaccard([x for x in ROWS if x[0] is not None]) if d == c}
    assert {r["doc_id"] for r in near.collect()} == ids


def test_filters_decide_by_row(spark):
    """A row without an id, or with the id of another, stays or goes by its own text."""
    near = near_rows()
    rows = [(1, ROWS[3][1]), (1, "clean and short"), (None, ROWS[3][1]), (None, "clean too"), (None, near[0][1]), (None, near[0][1]), (7, None)]
    docs = table(spark, rows).repartition(2)
    benchmark = spark.createDataFrame([(1, ROWS[3][1])], "item_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in filters.uncontaminated(docs, benchmark).collect()]
    assert sorted(left, key=repr) == sorted([x for x in rows if x[1] != ROWS[3][1]], key=repr)
    left = [(r["doc_id"], r["text"]) for r in filters.one_of_each_group(docs).collect()]
    assert sorted(left, key=repr) == sorted([x for i, x in enumerate(rows) if i not in (2, 5)], key=repr)
    for f in (filters.distinct_documents, filters.one_of_each_group, lambda d: filters.uncontaminated(d, benchmark)):
        assert f(empty(spark)).count() == 0 and f(docs).columns == docs.columns


def test_good_documents(spark):
    good = [(i if i % 3 else None, f"The paper number {i} reads well, and its words differ from line to line.") for i in range(40)]
    bad = [(100 + i if i % 3 else None, "BUY!! NOW!! " * 20) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in (*range(40), *range(100, 140))], "doc_id long, quality int, toxic int")
    docs = table(spark, [*good, *bad])
    left = filters.good_documents(docs, labels)
    assert left.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in left.collect() if r["doc_id"] is not None) == sorted(x for x in good if x[0] is not None)
    assert sum(r["doc_id"] is None for r in left.collect()) == sum(x[0] is None for x in good)
    assert filters.good_documents(empty(spark), labels).count() == 0
