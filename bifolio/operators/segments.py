"""Blocks transformed and made durable while a task runs.

A task writes what it has done every few seconds as a segment: a Parquet file of one
bucket in the store's own folder, written under a hidden name and then renamed, so it is
there whole or not at all. A task that dies loses its last segment's blocks alone; its
next attempt reads the keys of the segments that it left and goes on after them. A file in
the store asks all tasks to stop; they write what they have and end.

A segment's name tells how many blocks and words it holds, so a run's progress is a
listing of names. All segments of a run carry its commit's number as ``seq``.
"""

from __future__ import annotations

import os
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .shared import created, names, opened
from .transform import Translate

SECONDS, MOST_BLOCKS = 5.0, 5_000
#: How often a task looks whether it is asked to stop.
LOOK_SECONDS = 1.0
REPORT = "pair string, bucket int, segment string, blocks long, words long"
ROWS = pa.schema([("sha256", pa.string()), ("chapter_idx", pa.int32()), ("block_idx", pa.int32()), ("t", pa.string()), ("seq", pa.int64())])
#: <commit>-<partition>-<attempt>-<place>-<blocks>-<words>, and the bucket as the table's reader expects it.
NAME = "seg-{:010d}-{:06d}-{}-{:06d}-{}-{}_{:05d}.c000.parquet"
_COUNTS = re.compile(r"seg-\d+-\d+-[^-]+-\d+-(\d+)-(\d+)_")


#: Fixed value: what the names of partition folders can't hold as it is.
_ESCAPED = re.compile(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]")


def folder(pair: str) -> str:
    return "pair=" + _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", pair)


def pair_of(folder: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), folder.removeprefix("pair="))


def committed(left: DataFrame, make: Callable[[], Translate], path: str, number: int, settings: dict[str, str] | None = None, seconds: float = SECONDS, most: int = MOST_BLOCKS) -> DataFrame:
    """A row a segment; running it translates the blocks (KEY, text) and adds them to the store.

    ``make`` builds the function once a task, after ``settings`` were put in the
    worker's environment. A segment ends after ``seconds`` or ``most`` blocks.
    """
    spark = left.sparkSession
    opened(path)  # an error here rather than in tasks
    n = store.buckets(spark, path)
    bucket = F.pmod(F.hash(*store.PLACED), F.lit(n))
    rows = left.select(*store.PLACED, "pair", "text").repartition(n, *store.PLACED).sortWithinPartitions("pair", *store.PLACED).withColumn("bucket", bucket)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), f"{task.attemptNumber()}.{uuid.uuid4().hex[:8]}"
        files, root = opened(path)
        have = _left_behind(files, root, number, part) if task.attemptNumber() else set()
        os.environ.update(settings or {})
        translate = None
        open_rows: dict[tuple[str, int], list[tuple]] = {}
        written, words, began, looked = 0, {}, time.monotonic(), 0.0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal written, began
            for (pair, bucket), some in open_rows.items():
                count = sum(words.pop((pair, bucket)))
                at = f"{root}/{folder(pair)}"
                files.create_dir(at, recursive=True)
                name = NAME.format(number, part, attempt, written, len(some), count, bucket)
                hidden = f"{at}/_{name}"
                with files.open_output_stream(hidden) as out:
                    pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), ROWS, strict=True)], schema=ROWS), out)
                files.move(hidden, f"{at}/{name}")
                written += 1
                yield pa.RecordBatch.from_pylist([{"pair": pair, "bucket": bucket, "segment": name, "blocks": len(some), "words": count}], pa.schema([("pair", pa.string()), ("bucket", pa.int32()), ("segment", pa.string()), ("blocks", pa.int64()), ("words", pa.int64())]))
            open_rows.clear()
            began = time.monotonic()

        for batch in batches:
            for sha, chapter, block, pair, text, bucket in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = time.monotonic()
                if now - looked >= LOOK_SECONDS:
                    looked = now
                    if files.get_file_info(f"{root}/_stop-{number}").type.name == "File":
                        yield from flush()
                        return
                if (pair, sha, chapter, block) in have:
                    continue
                translate = translate or make()
                open_rows.setdefault((pair, bucket), []).append((sha, chapter, block, translate(text), number))
                words.setdefault((pair, bucket), []).append(len((text or "").split()))
                if time.monotonic() - began >= seconds or sum(map(len, open_rows.values())) >= most:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, REPORT)


def _left_behind(files, root: str, number: int, part: int) -> set[tuple]:
    """The keys that earlier attempts of a task have written."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    have: set[tuple] = set()
    for pair in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if pair.type != fs.FileType.Directory or not pair.base_name.startswith("pair="):
            continue
        for f in files.get_file_info(fs.FileSelector(pair.path)):
            if f.base_name.startswith(f"seg-{number:010d}-{part:06d}-"):
                found = pq.read_table(f.path, filesystem=files, partitioning=None, columns=["sha256", "chapter_idx", "block_idx"])
                have.update((pair_of(pair.base_name), *k) for k in zip(*(c.to_pylist() for c in found.columns), strict=True))
    return have


def progress(spark: SparkSession, path: str, number: int) -> tuple[int, int]:
    """(blocks, words) that a run has made durable so far."""
    counts = [m.groups() for name in names(spark, f"{path}/pair=*/seg-{number:010d}-*") if (m := _COUNTS.match(name))]
    return sum(int(b) for b, _ in counts), sum(int(w) for _, w in counts)


def stop(spark: SparkSession, path: str, number: int) -> None:
    """Ask a run's tasks to write what they have and end."""
    created(spark, f"{path}/_stop-{number}")
