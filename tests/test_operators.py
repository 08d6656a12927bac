"""Operators of the pipeline, the pipeline itself, and the driver contract."""

import importlib
import json
import os
import random
import re
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from bifolio.functions import text as T
from bifolio.operators import detection, language, layout, profile, render, segments, store, transform
from bifolio.plans import pipeline
from bifolio.plans.queries import PACKAGES, QUERIES
from bifolio.schema import BLOCKS, MARK_IMAGE, MARK_TABLE, TRANSLATIONS
from bifolio.sources.errors import ReadError
from bifolio.streaming import arrivals

SF = "/root/testdata/sf0.001"
LOWER = layout.LOWER


def blocks(spark, rows):
    return spark.createDataFrame(rows, BLOCKS)


def test_sample_text_equals_a_loop(spark):
    r = random.Random(1)
    rows = [(str(d), c, b, r.choice(["paragraph", "heading", "marker"]), "x" * r.randrange(1, 60), "", 2) for d in range(30) for c in range(2) for b in range(r.randrange(1, 12))]
    found = {x["doc_id"]: x["sample"] for x in profile.sample_text(blocks(spark, rows), 100).collect()}
    for d in range(30):
        texts, size = [], 0
        for x in [x for x in rows if x[0] == str(d) and x[3] != "marker"]:
            texts.append(x[4])
            size += len(x[4])
            if size >= 100:
                break
        assert found.get(str(d), "") == "\n".join(texts)[:100]


def test_volume_and_summary(spark):
    rows = [("a", 0, 0, "heading", "One two", "", 1), ("a", 0, 1, "paragraph", "three", "", 2), ("a", 0, 2, "marker", MARK_IMAGE, "", 2)]
    chapters = spark.createDataFrame([("a", 0), ("b", 0)], "doc_id string, chapter_idx int")
    volumes = profile.volume(blocks(spark, rows), chapters)
    assert {tuple(r) for r in volumes.collect()} == {("a", 3, 1, 2, 1), ("b", 0, 0, 0, 1)}
    lines = {r["doc_id"]: r["line"] for r in profile.volume_line(volumes.withColumn("words", F.col("words") * 1000)).collect()}
    assert lines["a"] == "Volumen: 3.000 palabras · 1 párrafos · 1 capítulo"
    row = spark.range(1).select(T.duration(F.lit(59.4)).alias("a"), T.duration(F.lit(61)).alias("b"), T.duration(F.lit(7322)).alias("c"), T.chapter_file(F.lit(1234)).alias("d"), T.rate_and_eta(F.lit(10), F.lit(30), F.lit(5.0)).alias("e")).head()
    assert (row["a"], row["b"], row["c"], row["d"], tuple(row["e"])) == ("59 s", "1 min 1 s", "2 h 2 min", "cap-1234.jsonl", (2.0, 10.0))


def test_merge_fragments_equals_a_loop(spark):
    r = random.Random(2)
    texts = ["Ends.", "open", "lower start", "hyphen-", "Upper", "quote”", "élan", "x"]
    rows = [(d, b, r.choice(["paragraph"] * 4 + ["marker"]), r.choice(texts)) for d in range(40) for b in range(r.randrange(1, 9))]
    df = spark.createDataFrame([(*x, x[3]) for x in rows], "doc_id int, block_idx int, kind string, text string, html string")
    found = [(x["doc_id"], x["kind"], x["text"], x["html"]) for x in layout.merge_fragments(df, ["doc_id"], ["block_idx"]).orderBy("doc_id", "pos").collect()]
    want = []
    for d, _, k, t in rows:
        last = want[-1] if want and want[-1][0] == d else None
        if last and last[1] == k == "paragraph" and (last[2].endswith("-") or (not re.search(r"[.!?:;…»”\"']\s*$", last[2]) and re.match(f"[{LOWER}]", t))):
            want[-1] = (d, k, last[2][:-1] + t if last[2].endswith("-") else f"{last[2]} {t}")
        else:
            want.append((d, k, t))
    assert found == [(*x, x[2]) for x in want]


def test_layout(spark):
    box = lambda *x: dict(zip(("x0", "y0", "x1", "y1"), map(float, x), strict=True))
    line = lambda *spans: [{"text": t, "flags": f} for t, f in spans]
    rows = [
        ("a", 0, 0, 0, box(0, 0, 10, 10), [line(("A bold ", 16)), line(("hyphen-", 2)), line(("ated text,", 0))]),
        ("a", 0, 1, 0, box(20, 0, 30, 10), [line(("cell", 0))]),
        ("a", 0, 2, 0, box(22, 0, 32, 10), [line(("cell", 0))]),
        ("a", 0, 3, 0, box(27, 0, 47, 10), [line(("half out", 0))]),
        ("a", 0, 4, 0, box(0, 50, 1, 51), [line(("12", 0))]),
        ("a", 1, 0, 1, box(0, 0, 1, 1), []),
        ("a", 2, 0, 0, box(0, 0, 1, 1), [line(("goes", 0)), line(("on", 0))]),
        ("a", 2, 1, 0, box(0, 2, 1, 3), [line(("here.", 0))]),
    ]
    kind = "struct<x0:double,y0:double,x1:double,y1:double>"
    pdf = spark.createDataFrame(rows, f"doc_id string, page int, pos int, type int, bbox {kind}, lines array<array<struct<text:string,flags:int>>>")
    tables = spark.createDataFrame([("a", 0, 0, box(20, 0, 35, 10))], f"doc_id string, page int, table_idx int, bbox {kind}")
    found = [(r["kind"], r["text"], r["html"]) for r in layout.layout_blocks(pdf, tables).orderBy("block_idx").collect()]
    assert found == [
        ("paragraph", "A bold hyphenated text,", "<b>A bold </b> <i>hyphen</i>ated text,"),
        ("marker", MARK_TABLE, ""),
        ("paragraph", "half out", "half out"),
        ("marker", MARK_IMAGE, ""),
        ("paragraph", "goes on here.", "goes on here."),
    ]
    assert [tuple(r) for r in layout.scanned_pages(pdf).collect()] == [("a", 1, [2])]


def test_languages(spark):
    packages = language.packages_table(spark, [*PACKAGES, ("xa", "", "xb", None, False, 99), ("zz", "French", "en", "English", False, 100)])
    answers = spark.createDataFrame([("FRÉNCH",), ("ingles",), ("zt",), ("e",), (None,), ("Strasse",)], "answer string")
    assert {r["answer"]: r["code"] for r in language.look_up(answers, packages).collect()} == {"FRÉNCH": "zz", "ingles": "en", "zt": "zt", "e": None, None: None, "Strasse": None}
    odd = language.packages_table(spark, [("q1", "Straße", "q2", "ÎLE d’Été", True, 1), ("q3", "ΣΊΣΥΦΟΣ", "q4", "  Padded\u3000", True, 2)])
    typed = [("STRASSE", "q1"), ("straße", "q1"), ("ile D’ete", "q2"), ("Île d’été", "q2"), ("σίσυφος", "q3"), ("padded", "q4"), ("\tPADDED ", "q4"), ("Ile", None), ("ESPAÑOL", "es"), ("EN", "en"), ("", None), ("  ", None)]
    found = language.look_up(spark.createDataFrame([(a,) for a, _ in typed], "answer string"), odd)
    assert {r["answer"]: r["code"] for r in found.collect()} == dict(typed) and "Python" not in found._jdf.queryExecution().toString()
    names = {r["code"]: r["name"] for r in language.catalogue(packages).collect()}
    assert names["fr"] == "French" and names["xa"] == "xa" and names["xb"] == "xb"
    assert language.language_list(packages).head()[0].startswith("Catalan (ca), English (en)")
    pairs = spark.createDataFrame([("fr", "es"), ("es", "es"), ("en", "es"), ("de", "es"), ("es", "de"), ("ca", "fr"), ("de", "pt"), ("fr", "pt")], "source string, target string")
    plan = {(r["source"], r["target"]): (r["pivot"], [tuple(s) for s in r["to_install"]], r["error"] is None) for r in language.pair_plan(pairs, packages).collect()}
    assert plan == {
        ("fr", "es"): (True, [], True),  # an installed pivot beats an available direct pair
        ("es", "es"): (False, [], False), ("en", "es"): (False, [], True), ("de", "es"): (True, [("de", "en")], True), ("es", "de"): (False, [], False),
        ("ca", "fr"): (False, [], False), ("de", "pt"): (True, [("de", "en"), ("en", "pt")], True), ("fr", "pt"): (True, [("en", "pt")], True),
    }
    wanted = language.provision(language.pair_plan(pairs, packages), packages)
    assert {(r["from_code"], r["to_code"]) for r in wanted.collect()} == {("de", "en"), ("en", "pt")}
    samples = spark.createDataFrame([("the cat is on the mat",), (" ",), (None,)], "sample string")
    assert [r["detected"] for r in language.detect(samples, lambda: lambda t: "en-GB").collect()] == ["en", None, None]
    assert [r["detected"] for r in language.detect(samples, lambda: lambda t: "zh-cn").collect()] == ["zh", None, None]
    assert [r["detected"] for r in language.detect(samples, lambda: lambda t: 1 / 0).collect()] == [None] * 3


def test_detection(spark):
    texts = [("en", "the cat is on the mat and the dog is in the house"), ("zh-cn", "el gato y el perro"), ("pt-br", "não há pão na mesa"), (None, "la la la"), ("en", None), ("xx", "12 34")]
    model = detection.learnt(spark.createDataFrame(texts, "lang string, text string"))
    samples = spark.createDataFrame([(1, "The dog on the mat"), (2, "el perro"), (3, "PÃO e não"), (4, " "), (5, None), (6, "12 34"), (7, "ΩΩΩ"), (1, "The dog on the mat")], "doc_id long, sample string")
    found = [(r["doc_id"], r["detected"]) for r in detection.detected(samples.dropDuplicates(), model).collect()]
    assert sorted(found) == [(1, "en"), (2, "zh"), (3, "pt"), (4, None), (5, None), (6, None), (7, None)]
    assert detection.learnt(spark.createDataFrame([], "lang string, text string")).collect() == []
    plan = detection.detected(samples, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_many_languages_as_rows(spark, monkeypatch):
    texts = spark.createDataFrame([("en", "the cat"), ("es", "el gato"), ("pt", "o gato"), ("fr", "le chat")], "lang string, text string")
    samples = spark.createDataFrame([(1, "the cats"), (2, "gato"), (3, "\U0001d4b3\U0001d4b4 chat"), (4, "zzz")], "doc_id long, sample string")
    model = detection.learnt(texts)
    few = sorted(map(tuple, detection.detected(samples, model).collect()))
    monkeypatch.setattr(detection, "MOST_COLUMNS", 3)
    assert few == sorted(map(tuple, detection.detected(samples, model).collect()))
    assert few[0] == (1, "en") and few[3] == (4, None)


def test_texts_are_read_once_to_learn(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(t):
        read.add(1)
        return t

    texts = spark.createDataFrame([("en", "the cat"), ("es", "el gato")], "lang string, text string").withColumn("text", F.udf(seen, "string").asNondeterministic()("text"))
    samples = spark.createDataFrame([(1, "the cat")], "doc_id long, sample string")
    assert detection.detected(samples, detection.learnt(texts)).collect() == [(1, "en")]
    assert read.value == 2


def test_trigrams_are_of_characters(spark):
    found = spark.createDataFrame([("A\U0001d4b3\n b",), ("",), (None,)], "t string").select(detection.grams(F.col("t")).alias("g")).collect()
    assert [r["g"] for r in found] == [[" a\U0001d4b3", "a\U0001d4b3 ", "\U0001d4b3 b", " b "], [], []]


def test_detection_of_texts_left_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.substring("text", 1, 4000).alias("sample")).filter("lang is not null")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = detection.detected(docs.filter(held), detection.learnt(docs.filter(~held), text_col="sample")).join(docs, "doc_id")
    rate = found.agg(F.avg((F.col("detected") == F.col("lang")).cast("int"))).head()[0]
    assert rate > 0.95


def test_job_folder(spark, tmp_path):
    job = tmp_path / "job"
    job.mkdir()
    (job / "cap-000.jsonl").write_text('{"b": 0, "t": "old"}\n{"b": "3", "t": "é"}\n\n{"b": 0, "t": "new"}\n{"b": 1, "t": "cut', encoding="utf-8")
    (job / "cap-012.jsonl").write_text('{"b": 5, "t": "x"}\n{"t": "no key"}\n[1]\n')
    found = lambda: {(r["chapter_idx"], r["block_idx"], r["t"]) for r in store.read_jsonl(spark, f"file://{job}", "abc", "en-es").collect()}
    want = {(0, 0, "new"), (0, 3, "é"), (12, 5, "x")}
    assert found() == want  # without meta.json the files are taken as they are
    (job / "meta.json").write_text(json.dumps({"sha256": "abc", "pair": "en-es"}))
    assert found() == want
    store.write_jsonl(store.read_jsonl(spark, f"file://{job}", "abc", "en-es"), f"file://{tmp_path}/copy", "abc", "en-es")
    assert {(r["chapter_idx"], r["block_idx"], r["t"]) for r in store.read_jsonl(spark, f"file://{tmp_path}/copy", "abc", "en-es").collect()} == want
    assert json.loads((tmp_path / "copy" / "cap-000.jsonl").read_text(encoding="utf-8").split("\n")[0]) == {"b": 0, "t": "new"}
    (job / "meta.json").write_text(json.dumps({"sha256": "other", "pair": "en-es"}))
    assert found() == set() and not job.exists()  # a stale folder goes


@pytest.fixture
def few_buckets(monkeypatch):
    monkeypatch.setattr(store, "BUCKETS", 4)


def test_store_ends_jobs_and_compacts(spark, tmp_path, few_buckets):
    at = f"file://{tmp_path}/store"
    rows = [("a", "en-es", 0, 0, "old", 1), ("a", "en-es", 0, 0, "new", 2), ("b", "en-es", 0, 0, "b", 1), ("a", "en-fr", 0, 0, "fr", 1)]
    assert store.append(spark.createDataFrame(rows, TRANSLATIONS), at) == 1
    have = lambda path, *pair: {(r["sha256"], r["pair"], r["t"]) for r in store.stored(spark, path, *pair).collect()}
    assert have(at) == {("a", "en-es", "new"), ("b", "en-es", "b"), ("a", "en-fr", "fr")}
    assert have(at, "en-fr") == {("a", "en-fr", "fr")} and have(at, "xx") == set() and have(f"{at}-none") == set()
    assert store.discard(spark, at, spark.createDataFrame([("a",)], "sha256 string"), "en-es") == 2
    assert have(at) == {("b", "en-es", "b"), ("a", "en-fr", "fr")} and have(at, "en-es") == {("b", "en-es", "b")}
    store.append(spark.createDataFrame([("a", "en-es", 0, 0, "again")], "sha256 string, pair string, chapter_idx int, block_idx int, t string"), at)
    assert ("a", "en-es", "again") in have(at)
    store.compact(spark, at, f"file://{tmp_path}/new")
    assert have(f"file://{tmp_path}/new") == have(at) and spark.read.parquet(f"file://{tmp_path}/new").count() == 3
    store.drop_if_empty(spark, at)
    assert (tmp_path / "store").exists()
    for pair in ("en-es", "en-fr"):
        store.discard(spark, at, spark.createDataFrame([("a",), ("b",)], "sha256 string"), pair)
    store.drop_if_empty(spark, at)
    assert not (tmp_path / "store").exists() and have(at) == set()


def test_commits_are_numbered_by_the_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "KEPT_NUMBERS", 3)
    at = f"file://{tmp_path}/store"
    assert [store.next_commit(spark, at) for _ in range(12)] == [*range(1, 13)] and len(list((tmp_path / "store" / "_commits").glob("[0-9]*"))) <= 4
    (tmp_path / "store" / "_commits" / "13").touch()  # another driver was faster
    assert store.next_commit(spark, at) == 14


def test_store_is_joined_where_it_lies(spark, tmp_path, few_buckets):
    """Reading a pair opens its folder alone, and neither grouping nor joining the store shuffles its side."""
    at = f"file://{tmp_path}/store"
    rows = [(f"s{i}", pair, 0, i, f"t{i}", 1) for i in range(50) for pair in ("en-es", "en-fr")]
    store.append(spark.createDataFrame(rows, TRANSLATIONS), at)
    store.discard(spark, at, spark.createDataFrame([("s1",)], "sha256 string"), "en-es")
    keyed = blocks(spark, [("d", 0, i, "paragraph", "x", "", 2) for i in range(60)]).withColumn("sha256", F.concat(F.lit("s"), "block_idx")).withColumn("pair", F.lit("en-es"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = store.pending(keyed, store.stored(spark, at, "en-es"), "en-es")
        assert sorted(r["block_idx"] for r in left.collect()) == [1, *range(50, 60)]
        plan = left._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # the blocks' and that of the jobs that ended, whose rows are broadcast; none of the store's rows
        assert plan.count("Exchange hashpartitioning(sha256#") == 2 and plan.count(", block_idx#") and plan.count("Exchange") == 3, plan
        (scan,) = [x for x in plan.split("\n") if "FileScan parquet spark_catalog.default.store_" in x]
        assert "Bucketed: true" in scan and "(pair#" in scan and "= en-es)" in scan, scan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def killed(spark, left, make, at, number, **how):
    with pytest.raises(Exception, match="killed"):
        segments.committed(left, make, at, number, **how).write.format("noop").mode("overwrite").save()


def test_killed_task_leaves_its_segments(spark, tmp_path, monkeypatch):
    """Blocks are durable while a task runs: one that dies after five of them, with segments of two, leaves four."""
    monkeypatch.setattr(store, "BUCKETS", 1)
    at = f"file://{tmp_path}/store"
    keyed = blocks(spark, [("d", 0, i, "paragraph", f"text {i}", "", 2) for i in range(9)]).withColumn("sha256", F.lit("s")).withColumn("pair", F.lit("en-es"))
    calls = spark.sparkContext.accumulator(0)

    def make(dies=True):
        seen = [0]

        def translate(t):
            seen[0] += 1
            calls.add(1)
            if dies and seen[0] > 5:
                raise RuntimeError("killed")
            return t.upper()

        return translate

    killed(spark, keyed, make, at, store.next_commit(spark, at), most=2)
    assert {r["t"] for r in store.stored(spark, at, "en-es").collect()} == {f"TEXT {i}" for i in range(4)}
    assert not list((tmp_path / "store" / "pair=en-es").glob("_*.tmp")) and segments.progress(spark, at, 1) == (4, 8)
    left = store.pending(keyed, store.stored(spark, at, "en-es"), "en-es")
    number = store.next_commit(spark, at)
    found = segments.committed(left, lambda: make(False), at, number, most=2).collect()
    assert sum(r["blocks"] for r in found) == 5 and {r["t"] for r in store.stored(spark, at, "en-es").collect()} == {f"TEXT {i}" for i in range(9)}
    assert segments.progress(spark, at, number) == (5, 10)
    # a task's next attempt finds what the one before has left
    store_files, root = segments.opened(at)
    assert segments._left_behind(store_files, root, number, 0) == {("en-es", "s", 0, i) for i in range(4, 9)}
    segments.stop(spark, at, 99)
    assert segments.committed(keyed, lambda: make(False), at, 99).collect() == []
    with pytest.raises(ValueError, match="tasks can't write"):
        segments.opened("abfss://x@y/z")


def test_folders_of_pairs():
    for pair in ("en-es", "a/b", "100%", "x=y", "é"):
        assert "/" not in segments.folder(pair) and segments.pair_of(segments.folder(pair)) == pair


def test_pipeline_resumes(spark, tmp_path, few_buckets):
    inputs, at, out = tmp_path / "in", f"file://{tmp_path}/store", f"file://{tmp_path}/out"
    inputs.mkdir()
    (inputs / "a.txt").write_text("# Head\n\nfirst *one*\n\n![i](u)\n\nsecond\n")
    (inputs / "b.epub").write_bytes(b"broken")
    packages = language.packages_table(spark, PACKAGES)
    seed = spark.read.format("binaryFile").load(f"file://{inputs}/a.txt").select(F.sha2("content", 256)).head()[0]
    store.append(spark.createDataFrame([(seed, "en-es", 0, 0, "SENTINEL", 1), (seed, "en-fr", 0, 1, "other pair", 1)], TRANSLATIONS), at)
    calls = spark.sparkContext.accumulator(0)

    def make():
        def translate(t):
            calls.add(1)
            return t.upper()

        return translate

    with pytest.raises(pipeline.Stopped):
        pipeline.run(spark, [f"file://{inputs}"], "en", "es", make, packages, out, at, should_stop=lambda: True)
    assert not list((tmp_path / "out").glob("_work-*"))
    told = []
    result = pipeline.run(spark, [f"file://{inputs}"], "en", "es", make, packages, out, at, on_progress=told.append)
    assert (told[-1].done, told[-1].total, told[-1].words, told[-1].eta) == (2, 2, 3, 0) and result.progress == told[-1]
    assert not list((tmp_path / "out").glob("_work-*"))
    (page,) = [open(r["path"].removeprefix("file://"), encoding="utf-8").read() for r in result.written.collect()]
    assert calls.value == 2 and "SENTINEL" in page and ">SECOND</td>" in page and "first <i>one</i>" in page and page.count("fila-marca") == 2
    assert page.count('<tr><td lang="en">') == 2 and page.count('nivel-1"') == 1
    summary = {r["doc_id"].rsplit("/", 1)[-1]: r for r in result.summary.collect()}
    assert summary["a.txt"]["words"] == 4 and summary["b.epub"]["error"]
    assert {r["pair"] for r in store.stored(spark, at).collect()} == {"en-fr"}  # the run's own rows are gone
    with pytest.raises(ReadError):
        pipeline.run(spark, [f"file://{inputs}"], "es", "de", make, packages, out, at)


def test_run_reports_and_stops_while_it_runs(spark, tmp_path, few_buckets):
    """Several reports of one run, and a stop that keeps what is done."""
    inputs, at, out = tmp_path / "in", f"file://{tmp_path}/store", f"file://{tmp_path}/out"
    inputs.mkdir()
    (inputs / "a.txt").write_text("\n\n".join(f"paragraph {i}" for i in range(60)))
    packages = language.packages_table(spark, PACKAGES)

    def make():
        import time

        def translate(t):
            time.sleep(0.2)
            return t.upper()

        return translate

    told = []
    with pytest.raises(pipeline.Stopped):
        pipeline.run(spark, [f"file://{inputs}"], "en", "es", make, packages, out, at, seconds=0.1, report_seconds=0.3, on_progress=told.append, should_stop=lambda: bool(told) and told[-1].done > 5)
    kept = store.stored(spark, at, "en-es").count()
    assert len(told) > 2 and [p.done for p in told] == sorted(p.done for p in told) and told[-1].rate and 5 < kept < 60
    assert not list((tmp_path / "store").glob("_stop*"))
    result = pipeline.run(spark, [f"file://{inputs}"], "en", "es", make, packages, out, at, seconds=0.5)
    assert result.progress.done == 60 - kept and not (tmp_path / "store").exists()


def test_transform_and_alignment(spark):
    rows = [("a", 0, i, k, t, "", 9) for i, (k, t) in enumerate([("heading", "h<"), ("marker", MARK_IMAGE), ("paragraph", 'p"')])]
    keyed = blocks(spark, rows).withColumn("sha256", F.lit("s")).withColumn("pair", F.lit("en-es"))
    none = spark.createDataFrame([], TRANSLATIONS).drop("seq")
    done = transform.transformed(store.pending(keyed, none), lambda: str.upper, 3)
    whole = render.aligned(keyed, done, store.KEY)
    got = [r["row"] for r in render.rows(whole, F.lit("en"), F.lit("es")).orderBy("block_idx").collect()]
    env = transform.transformed(store.pending(keyed, none), lambda: lambda t: os.environ["SEGMENTER"], settings={"SEGMENTER": "spacy"})
    assert {r["t"] for r in env.collect()} == {"spacy"}
    assert len(got) == 3 and "nivel-6" in got[0] and "h&lt;" in got[0] and "H&lt;" in got[0] and got[2].endswith('<td lang="es">P&quot;</td></tr>')


def test_arrivals(spark, tmp_path, few_buckets):
    docs = spark.createDataFrame([(1, "# a\n\nb"), (2, None)], "doc_id long, text string")
    at = f"file://{tmp_path}/store"
    for _ in range(2):
        docs.write.mode("append").parquet(f"file://{tmp_path}/in")
        query = arrivals.translate_arrivals(spark, f"file://{tmp_path}/in", "doc_id long, text string", "en-es", lambda: str.upper, at, f"file://{tmp_path}/check")
        query.awaitTermination()
    assert sorted(r["t"] for r in spark.read.parquet(at).collect()) == ["A", "B"]
    contents = spark.read.parquet(at).select("sha256").distinct()
    store.discard(spark, at, contents, "en-es")
    assert store.stored(spark, at).isEmpty()
    docs.write.mode("append").parquet(f"file://{tmp_path}/in")  # after the job ended, the same texts start afresh
    arrivals.translate_arrivals(spark, f"file://{tmp_path}/in", "doc_id long, text string", "en-es", lambda: str.upper, at, f"file://{tmp_path}/check").awaitTermination()
    assert sorted(r["t"] for r in store.stored(spark, at).collect()) == ["A", "B"]


def test_shuffle_partitions_do_not_matter(spark):
    want = None
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted(map(tuple, QUERIES["rendered_document"][0](spark, SF).collect()))
        assert want in (None, got)
        want = got
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    query, sql = QUERIES[name]
    found = query(spark, SF)
    rows = found.collect()
    assert rows
    if not sql:
        return
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted((tuple(r[n] for n in names) for r in rows), key=repr) == sorted(map(tuple, cursor.fetchall()), key=repr)


def test_page_volume_walks_each_page_once(spark):
    plan = QUERIES["page_volume"][0](spark, SF)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("MapInArrow") == 1


def test_store_query_splits_documents_once(spark):
    plan = QUERIES["resume_from_store"][0](spark, SF)._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_works_without_the_training_data_folders(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("bifolio.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(k.startswith("op") for k in e.queries())
"""
    root = importlib.import_module("bifolio").__path__[0].rsplit("/", 1)[0]
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def test_rest_passes_where_the_folders_are_deleted(tmp_path):
    """A copy of the repository without them: it imports, queries run, and some of the rest's tests pass."""
    root = importlib.import_module("bifolio").__path__[0].rsplit("/", 1)[0]
    gone = lambda folder, names: [n for n in names if n in ("llm", ".git", "__pycache__", "corpus_pipeline.py")]
    shutil.copytree(root, tmp_path / "copy", ignore=gone)
    some = "test_contract or test_html_rules or test_transform_and_alignment or (test_queries_equal_their_sql and conversation_blocks)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-x", "-k", some], cwd=tmp_path / "copy", env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout[-2000:]
