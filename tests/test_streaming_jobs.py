"""Jobs whose blocks and translations arrive batch by batch."""

from pyspark.sql import functions as F

from bifolio.operators import render
from bifolio.schema import MARK_IMAGE
from bifolio.streaming import jobs

BLOCKS = "job string, blocks int, chapter_idx int, block_idx int, kind string, text string, html string, level int"
DONE = "job string, chapter_idx int, block_idx int, t string"


def run(spark, tmp_path, blocks, done, stalled_ms=jobs.STALLED_MS):
    """One micro-batch with these rows; the pages that come of it."""
    spark.createDataFrame(blocks, BLOCKS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/blocks")
    spark.createDataFrame(done, DONE).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/done")
    read = lambda name, schema: spark.readStream.schema(schema).parquet(f"file://{tmp_path}/{name}")
    out = []
    query = jobs.started(jobs.events(read("blocks", BLOCKS), read("done", DONE), F.lit("en"), F.lit("es")), lambda df, n: out.extend(df.collect()), f"file://{tmp_path}/check", stalled_ms, availableNow=True)
    query.awaitTermination()
    return out


def left(spark, tmp_path):
    return sum(spark.read.format("statestore").option("path", f"file://{tmp_path}/check").option("stateVarName", name).load().count() for name in ("rows", "done", "count"))


def test_page_comes_with_the_last_translation(spark, tmp_path):
    rows = [("a", 3, 0, 0, "heading", "Head <1>", "", 1), ("a", 3, 0, 1, "marker", MARK_IMAGE, "", 2), ("a", 3, 1, 0, "paragraph", "x\x00y", "<i>xy</i>", 2)]
    assert run(spark, tmp_path, rows[:2], [("a", 1, 0, "first"), ("b", 0, 0, "early")]) == [] and left(spark, tmp_path) == 6
    # the rest, with rows that come twice and a translation that is replaced
    (page,) = run(spark, tmp_path, rows[1:], [("a", 0, 0, "Título"), ("a", 1, 0, "se&gundo"), ("a", 0, 0, "Título")])
    want = render.rows(spark.createDataFrame([(*r[2:], t) for r, t in zip(rows, ("Título", None, "se&gundo"), strict=True)], "chapter_idx int, block_idx int, kind string, text string, html string, level int, t string").withColumn("doc_id", F.lit("a")), F.lit("en"), F.lit("es"))
    assert (page["job"], page["complete"], page["missing"]) == ("a", True, 0)
    assert page["body"] == render.bodies(want).head()["body"]
    assert left(spark, tmp_path) == 2  # of b alone
    # b has waited too long
    (page,) = run(spark, tmp_path, [("b", 2, 0, 0, "paragraph", "p", "", 2)], [], stalled_ms=0) or run(spark, tmp_path, [], [("c", 0, 0, "x")], stalled_ms=0)
    assert (page["job"], page["complete"]) == ("b", False)
