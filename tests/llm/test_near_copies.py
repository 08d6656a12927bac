"""The pipeline's near copies: five-word shingles, similarity 0.8, against brute force."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest

from bifolio.llm import components, jaccard_join
from tests.llm.test_operators import ROWS, near_rows, table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_near(rows, k=5, percent=80):
    """(id, shingles, least id of the component) of every row; ids aren't null here."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("chunk", [2048, 7])
def test_components(spark, chunk, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", chunk)
    rows = [*[x for x in ROWS if x[0] is not None and x[0] >= 100], *near_rows(), (11, near_rows()[11][1])]
    found = jaccard_join.jaccard_components(table(spark, rows).repartition(4), shingle=5, percent=80)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == brute_near(rows)


def test_allocation_at_80():
    for low, high in ((1, 1), (5, 9), (10, 11), (90, 99), (900, 1000)):
        most, ones, twos, spare = jaccard_join.allocation(low, high, 80)
        assert ones + 2 * twos == most + 1 + spare
        assert most >= max((s + high - 2 * -(-80 * (s + high) // 180)) for s in range(high, high * 100 // 80 + 1))


def test_stage(spark):
    """One changed word in 50 is a near copy for the stage, though not at three words and 0.9."""
    words = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:25], "other", *words[26:]])), (3, " ".join(words[:30])), (4, "quite another text of a few words")]
    assert {d for d, _, c in brute_near(rows) if d == c} == {1, 3, 4}
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, table(spark, rows), "").collect()} == {1, 3, 4}


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == {d for d, _, c in brute_near(rows) if d == c}


def test_the_last_links_take_no_rounds(spark, monkeypatch):
    """A long path and random links, with and without rounds: the same components, and few tables written for the last links."""
    r = random.Random(5)
    pairs = [(r.randrange(1 << 40) * 4000 + i, i) for i in range(2000)]
    names = [a for a, _ in pairs]
    links = [(names[i], names[i + 1]) for i in range(1000)] + [(names[1001 + r.randrange(900)], names[1001 + r.randrange(900)]) for _ in range(700)]
    up = {x: x for link in links for x in link}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    settled, written = components.settled, []
    monkeypatch.setattr(components, "settled", lambda df, name: written.append(name) or settled(df, name))
    rounds = []
    for few, kind in ((components.FEW, "long"), (components.FEW, "string"), (100, "long")):
        monkeypatch.setattr(components, "FEW", few)
        written.clear()
        found = components.connected(spark.createDataFrame(links, "a long, b long").selectExpr(f"cast(a as {kind}) a", f"cast(b as {kind}) b")).collect()
        rounds.append(len(written))
        got = {int(x["node"]): int(x["root"]) for x in found}
        linked = {x for a, b in links if a != b for x in (a, b)}
        assert set(got) == linked and len(found) == len(got)
        assert len({(find(x), got[x]) for x in linked}) == len({find(x) for x in linked}) == len(set(got.values()))
    assert rounds[0] == rounds[1] == 2 < rounds[2]


def test_sketches_are_compared_across_chunks_alone():
    """With sides, the pairs of one side and the other, each as without sides."""
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 190 + 5 * (i % 8)][: -1 - i], r.integers(0, 1 << 63, i % 7 * 4).astype(np.uint64)])) for i in range(24)]
    size = np.array([len(x) for x in sets])
    found = jaccard_join.sketches(np.concatenate(sets), np.concatenate(([0], np.cumsum(size))))
    side = r.integers(0, 2, len(sets))
    near = lambda i, j: len(set(jaccard_join.near_sketches([found[i], found[j]], size[[i, j]], 80))) == 1
    joined = jaccard_join.Joined(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if side[i] != side[j] and len(found[i]) == len(found[j]) and near(i, j):
                a, b = joined.find(i), joined.find(j)
                joined.up[max(a, b)] = min(a, b)
    assert len({len(x) for x in found}) == 1
    want, got = joined.roots(np.arange(len(sets))), jaccard_join.near_sketches(found, size, 80, side)
    assert len(set(zip(want.tolist(), got.tolist(), strict=True))) == len(set(want.tolist())) == len(set(got.tolist()))


def test_sketches_of_a_component_are_copied_less(spark):
    members = spark.range(10_000).selectExpr("1L cluster", "2 zone", "id k1", "hash(id) k2", "300 n")
    assert jaccard_join.chunk_pairs(members, ["cluster", "zone"]).count() == 50_000
    assert jaccard_join.chunk_pairs(members, ["cluster", "zone"], jaccard_join.SKETCHES).count() == 10_000
