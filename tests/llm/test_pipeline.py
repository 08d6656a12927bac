"""The pipeline on a small folder, against its parts by brute force."""

import corpus_pipeline
from pyspark.sql import functions as F

from bifolio.llm import quality
from bifolio.llm.common import crc_mod
from tests.llm.test_near_copies import brute_near
from tests.llm.test_operators import brute_contamination, brute_dedup

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scores = quality.quality_scores(docs, labels, learn=lambda i: crc_mod(i, 5) != 0)
    good = {r["doc_id"] for r in scores.filter(F.col("score") >= 0.3).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    keep = {v[0] for v in brute_dedup(rows).values()}
    rows = [x for x in rows if x[0] in keep]
    keep = {d for d, _, c in brute_near(rows) if d == c}
    rows = [x for x in rows if x[0] in keep]
    want = {d for d, *_, dirty in brute_contamination(rows, items) if not dirty}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in found} == want and len(found) == len(want)
    assert all(r["n_tokens"] == len(r["ids"]) for r in found)
    assert [name for name, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, file string, row long, at_file long, hit boolean"


def folder(spark, tmp_path, rows):
    """A data folder with documents of more columns than there are, labels and a benchmark."""
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 0.0, "f", 1, 2, True) for d, t in rows], SCHEMA)
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").withColumn("text", F.lit("x")).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("doc_id", F.lit(1)).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def by_text(df):
    return sorted((repr(r["doc_id"]), r["text"] or "") for r in df.collect())


def test_stages_decide_by_row(spark, tmp_path):
    """Rows without an id, with a repeated one, repeated rows, null and empty texts, clashing columns: each stage against brute force."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = max((t for _, t in docs if len(t.split()) < 400), key=lambda t: len(t.split())).split()
    near = [" ".join([*words[:i], f"changed{i}", *words[i + 1 :]]) for i in (20, 60, 100)]
    passage = next(t for _, t in items if len(t.split()) >= 12)
    rows = [*docs, (None, near[0]), (7, near[1]), (7, near[2]), (None, docs[3][1]), docs[4], docs[4], (None, docs[5][1] + " " + passage), (8, "short and clean " + passage), (None, None), (9, ""), (None, docs[6][1] + " one more")]
    sf = folder(spark, tmp_path / "data", rows)
    at = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in at.collect()]
        out = stage(spark, at, sf)
        assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        left = by_text(at)
        if name == "exact copies":
            want = sorted((repr(k), t) for t, (k, _) in brute_dedup(before).items())
            assert left == want
        if name == "near copies":
            numbered = [(i, t) for i, (_, t) in enumerate(sorted(before, key=lambda x: (x[0] is None, x[0] or 0)))]
            ids = [d for d, _ in sorted(before, key=lambda x: (x[0] is None, x[0] or 0))]
            groups = brute_near(numbered)
            assert len(left) == len({c for _, _, c in groups})
            first = {c for _, _, c in groups}
            assert sorted(d for d, _ in left) == sorted(repr(ids[c]) for c in first)
        if name == "benchmark passages":
            dirty = [(d, t) for d, t in before if brute_contamination([(d, t)], items)[0][5]]
            assert dirty and left == sorted((repr(d), t or "") for d, t in before if (d, t) not in dirty)
    coded = corpus_pipeline.tokens(spark, at, sf)
    assert coded.count() == at.count()


def test_empty_tables(spark, tmp_path):
    sf = folder(spark, tmp_path, [])
    found = corpus_pipeline.run(spark, sf)
    assert found.count() == 0 and "n_tokens" in found.columns
