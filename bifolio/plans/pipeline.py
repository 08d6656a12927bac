"""The whole way: files to aligned HTML, for many documents at once."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import language, profile, render, segments, store, transform
from ..operators.shared import exists, remove
from ..sources import datasource, files
from ..sources.errors import ReadError


# Fixed value: the warning of a translation in two steps.
PIVOT_NOTE = "Par sin traducción directa: se traduce por pivote en inglés (doble cómputo)."


class Stopped(Exception):
    """The run was asked to stop; the store keeps the blocks that are done."""


@dataclass
class Progress:
    """How a translation stands: what is durable of it."""

    done: int
    total: int
    words: int
    seconds: float

    @property
    def rate(self) -> float | None:
        """Blocks a second so far."""
        return self.done / self.seconds if self.done and self.seconds > 0 else None

    @property
    def eta(self) -> float | None:
        """Seconds left at this rate."""
        return (self.total - self.done) / self.rate if self.rate else None


@dataclass
class Result:
    summary: DataFrame
    written: DataFrame
    plan: DataFrame
    progress: Progress


def translated(left: DataFrame, make: Callable[[], transform.Translate], store_path: str, folder: str, settings: dict[str, str] | None = None, seconds: float = segments.SECONDS, report_seconds: float = 10.0, should_stop: Callable[[], bool] | None = None, on_progress: Callable[[Progress], None] | None = None) -> Progress:
    """Add the translations of ``left`` (written, so counted cheaply) to the store while tasks run; what each segment held goes to ``folder``.

    While the job runs, ``should_stop`` is asked and ``on_progress`` told every
    ``report_seconds`` (or at longer intervals, if looking takes a tenth of that).
    """
    spark, total = left.sparkSession, left.count()
    if should_stop and should_stop():
        raise Stopped
    number, began, over, failed = store.next_commit(spark, store_path), time.monotonic(), threading.Event(), []

    def watch() -> None:
        pause, asked = report_seconds, False
        while not over.wait(pause):
            try:
                looked = time.monotonic()
                if should_stop and not asked and should_stop():
                    segments.stop(spark, store_path, number)
                    asked = True
                if on_progress:
                    blocks, words = segments.progress(spark, store_path, number)
                    on_progress(Progress(blocks, total, words, time.monotonic() - began))
                pause = max(report_seconds, 10 * (time.monotonic() - looked))
            except Exception as e:  # raised where the caller sees it, when the tasks have ended
                failed.append(e)
                segments.stop(spark, store_path, number)
                return

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        segments.committed(left, make, store_path, number, settings, seconds).write.parquet(folder)
    finally:
        over.set()
        watcher.join()
    stopped = exists(spark, f"{store_path}/_stop-{number}")
    remove(spark, f"{store_path}/_stop-{number}")
    if failed:
        raise failed[0]
    blocks, words = segments.progress(spark, store_path, number)
    at = Progress(blocks, total, words, time.monotonic() - began)
    if on_progress:
        on_progress(at)
    if stopped and blocks < total:
        raise Stopped
    return at


def run(spark: SparkSession, paths: list[str], source: str, target: str, make: Callable[[], transform.Translate], packages: DataFrame, out: str, store_path: str, keep_store: bool = False, settings: dict[str, str] | None = None, **while_running) -> Result:
    """Translate all documents under ``paths`` and write a page each to ``out``.

    What the store has is taken from it; the rest is translated and added to it in
    segments of some seconds before anything is rendered, so a run that was cut
    short goes on where it was. ``while_running`` are the arguments of ``translated``:
    how often to commit, to report, whom to ask whether to stop. Documents that can't
    be read are in the summary with their error; its warnings are those of reading
    and, if the pair is reached by the pivot, a note of that. The store's rows of this
    run go when all pages are written, all in one step.
    """
    plan = language.pair_plan(spark.createDataFrame([(source, target)], "source string, target string"), packages)
    found = plan.head()
    if found["error"]:
        raise ReadError(found["error"])
    work, pair = f"{out}/_work-{uuid.uuid4().hex}", f"{source}-{target}"

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    try:
        # each file is read and parsed once
        documents, chapters, blocks = (written(t, name) for t, name in zip(files.tables(written(files.parse(datasource.scan(spark, *paths)), "parsed")), ("documents", "chapters", "blocks"), strict=True))
        keyed = blocks.join(documents.select("doc_id", "sha256"), "doc_id").withColumn("pair", F.lit(pair))
        left = written(store.pending(keyed, store.stored(spark, store_path, pair), pair).dropDuplicates(store.PLACED), "left")  # equal files are translated once
        progress = translated(left, make, store_path, f"{work}/segments", settings, **while_running)
        whole = render.aligned(keyed, store.stored(spark, store_path, pair), store.KEY)
        rows = render.rows(whole, F.lit(source), F.lit(target))
        body = render.bodies(rows).join(documents.select("doc_id", "title"), "doc_id").select("*", F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(found["pivot"]).alias("pivot"))
        render.write_files(render.pages(body), out).write.mode("overwrite").parquet(f"{out}/_written")
        pivot = F.when(F.lit(found["pivot"]), F.array(F.lit(PIVOT_NOTE))).otherwise(F.array().cast("array<string>"))
        profile.summary(documents.withColumn("warnings", F.when(F.col("error").isNull(), F.concat("warnings", pivot)).otherwise(F.col("warnings"))), profile.volume(blocks, chapters)).write.mode("overwrite").parquet(f"{out}/_summary")
        if not keep_store:
            store.discard(spark, store_path, documents.filter("error is null").select("sha256").distinct(), pair)
            store.drop_if_empty(spark, store_path)
    finally:
        remove(spark, work)
    return Result(spark.read.parquet(f"{out}/_summary"), spark.read.parquet(f"{out}/_written"), plan, progress)
