"""Pages of jobs whose blocks and translations arrive on streams.

A job's blocks and translations come in any order and in any batch, some of them
twice. Each job keeps what it has in state, an entry a block; with the last missing
piece its page is emitted and its state goes. A job for which nothing has come for a
while is emitted as it is, with the number of translations that it lacks, and its state
goes too: what was translated is in the store, so the job can be run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import escape
from ..operators import render
from ..operators.profile import translatable

#: A job is stalled when nothing has come for so long.
STALLED_MS = 3_600_000
PAGE = "job string, complete boolean, missing long, body string"
EVENT = "job string, blocks long, chapter_idx int, block_idx int, before string, after string, wanted boolean, t string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for the translation in a row that is rendered before it is there; no text keeps one.
_HERE = "\x00"


class Job(StatefulProcessor):
    """The state of one job: its blocks' rows around the translation, its translations, and counts of both."""

    def __init__(self, stalled_ms: int) -> None:
        self.stalled_ms = stalled_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "chapter_idx int, block_idx int", "before string, after string, wanted boolean")
        self.done = handle.getMapState("done", "chapter_idx int, block_idx int", "t string")
        self.count = handle.getValueState("count", "total long, rows long, wanted long, done long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        total, n_rows, wanted, done, timer = self.count.get() if self.count.exists() else (-1, 0, 0, 0, -1)
        for frame in rows:
            for e in frame.itertuples(index=False):
                at = (int(e.chapter_idx), int(e.block_idx))
                if pd.isna(e.blocks):  # a translation; the last one stays
                    done += not self.done.containsKey(at)
                    self.done.updateValue(at, (e.t,))
                else:
                    total = int(e.blocks)
                    if not self.rows.containsKey(at):
                        n_rows, wanted = n_rows + 1, wanted + bool(e.wanted)
                        self.rows.updateValue(at, (e.before, e.after, bool(e.wanted)))
        if n_rows == total and done >= wanted:
            page, missing = self._page()
            if not missing:
                self._clear(timer)
                yield self._out(key, True, 0, page)
                return
        expiry = timerValues.getCurrentProcessingTimeInMs() + self.stalled_ms
        if timer >= 0:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(expiry)
        self.count.update((total, n_rows, wanted, done, expiry))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        page, missing = self._page()
        self._clear(-1)
        yield self._out(key, False, missing, page)

    def _page(self) -> tuple[str, int]:
        done = {tuple(k): v[0] for k, v in self.done.iterator()}
        rows = sorted((tuple(k), tuple(v)) for k, v in self.rows.iterator())
        missing = sum(wanted and k not in done for k, (_, _, wanted) in rows)
        return "\n".join(before + ((done.get(k) or "") + after if wanted else "") for k, (before, after, wanted) in rows), missing

    def _clear(self, timer: int) -> None:
        if timer >= 0:
            self.handle.deleteTimer(timer)
        for state in (self.rows, self.done, self.count):
            state.clear()

    @staticmethod
    def _out(key: Any, complete: bool, missing: int, page: str) -> pd.DataFrame:
        return pd.DataFrame({"job": [key[0]], "complete": [complete], "missing": [missing], "body": [page]})

    def close(self) -> None:
        pass


def events(blocks: DataFrame, translations: DataFrame, source: Column, target: Column) -> DataFrame:
    """One stream of both: blocks (job, blocks: how many the job has, chapter_idx, block_idx, kind, text, html, level), rendered but for the translation, and translations (job, chapter_idx, block_idx, t), escaped."""
    clean = blocks.withColumns({c: F.replace(F.col(c), F.lit(_HERE), F.lit("")) for c in ("text", "html")}).withColumn("t", F.lit(_HERE))
    row = F.split(render.row(source, target), _HERE)
    placed = clean.select("job", F.col("blocks").cast("long").alias("blocks"), "chapter_idx", "block_idx", row[0].alias("before"), F.coalesce(F.get(row, F.lit(1)), F.lit("")).alias("after"), translatable().alias("wanted"), F.lit(None).cast("string").alias("t"))
    none = F.lit(None)
    done = translations.select("job", none.cast("long").alias("blocks"), "chapter_idx", "block_idx", none.cast("string").alias("before"), none.cast("string").alias("after"), none.cast("boolean").alias("wanted"), escape(F.coalesce("t", F.lit("")), quotes=True).alias("t"))
    return placed.unionByName(done)


def pages(rows: DataFrame, stalled_ms: int = STALLED_MS) -> DataFrame:
    """PAGE rows of a stream of ``events``: a job's body when it is complete, or when nothing has come for ``stalled_ms``."""
    return rows.groupBy("job").transformWithStateInPandas(Job(stalled_ms), PAGE, "append", "processingTime")


def started(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, stalled_ms: int = STALLED_MS, **trigger) -> StreamingQuery:
    """Run ``pages`` and give each batch of them to ``write``; state lies in RocksDB, which it needs."""
    conf, trigger = rows.sparkSession.conf, trigger or {"processingTime": "10 seconds"}
    # batches without rows let timers expire; a query that ends with its input would never end with them
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": str("processingTime" in trigger).lower()}
    before = {key: conf.get(key) for key in wanted}
    for key, value in wanted.items():
        conf.set(key, value)  # a query keeps what is set when it starts
    try:
        return pages(rows, stalled_ms).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        for key, value in before.items():
            conf.set(key, value)
