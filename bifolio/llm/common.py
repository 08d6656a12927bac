"""What the operators share: tables, the shared folder, sizes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file go to Python in batches of about so many bytes.
ARROW_BYTES = 4 << 20
#: A key with a larger share of all rows than one in so many counts as hot; so there are at most so many hot keys.
HOT_SHARE, LEAST_HOT = 50_000, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Only a local session, such as
    one of a test, may go without it and then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="shared-"))
    return spark.conf.get("spark.checkpoint.dir")


#: The paths that each open ``temporary`` block has given out, innermost last.
_GIVEN: ContextVar[tuple[list[str], ...]] = ContextVar("given", default=())


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets. It goes when the innermost ``temporary`` block around the call ends; without one it stays."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if given := _GIVEN.get():
        given[-1].append(path)
    return path


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared folder, when nothing that is still to be read comes from them."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """What is written in the shared folder within this block goes when it ends; what others have written, in this thread or elsewhere, stays.

    So DataFrames made within the block have to be written or collected there.
    """
    given: list[str] = []
    token = _GIVEN.set((*_GIVEN.get(), given))
    try:
        yield given
    finally:
        _GIVEN.reset(token)
        removed(spark, *given)


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again.

    It cuts the lineage, so a lost executor costs no step before it.
    """
    return settled_at(df, name)[0]


def settled_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, and the path, for those who remove it before its time."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables that a plan reads, as the optimizer knows them; counted where it doesn't."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if known < 1 << 50:
        return known
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    return int(df.agg(F.sum(sum(texts, F.lit(8)).cast("long"))).head()[0] or 0)


def pieces(df: DataFrame, each: int, least: int) -> int:
    """Into how many pieces of about ``each`` input bytes to deal a table."""
    return int(max(least, -(-input_bytes(df) // each)))


def crc_mod(col, k: int):
    """crc32 of an id as text, modulo k; null for a null id."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(k)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, which are 10,000 rows of any size else; a smaller bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if not (now and now.isdigit() and 0 < int(now) <= ARROW_BYTES):
        spark.conf.set(key, str(ARROW_BYTES))


_RELEASED = [0.0]


def release_memory(every: float = 0.0) -> None:
    """Give freed memory of this Python worker back to the system, at most once in ``every`` seconds."""
    import pyarrow as pa

    if time.monotonic() - _RELEASED[0] < every:
        return
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    _RELEASED[0] = time.monotonic()


def lean(run: Callable) -> Callable:
    """A function of batches (for ``mapInArrow``) whose worker keeps no freed memory for the next task."""

    @functools.wraps(run)
    def wrapped(batches: Iterable) -> Iterator:
        try:
            for out in run(batches):
                yield out
                release_memory(5.0)
        finally:
            release_memory()

    return wrapped


def lean_group(run: Callable) -> Callable:
    """The same for a function of one group's table (for ``applyInArrow``)."""

    def one(table):
        try:
            return run(table)
        finally:
            release_memory(1.0)

    def two(left, right):
        try:
            return run(left, right)
        finally:
            release_memory(1.0)

    return one if run.__code__.co_argcount == 1 else two


def located(docs: DataFrame, *keep: str, into: str | None = None) -> tuple[DataFrame, str, str]:
    """The rows with two more columns, whose names are returned, that tell each row from all others and lead back to it: a hash of its file's path, and its place in the file.

    The columns come from the scan, so they are the same in each reading. Rows that
    don't come straight from Parquet files are written to the shared folder first.
    ``keep`` names the columns that are needed (all, if none is given). ``into`` is where
    such rows are written if they have to be found there later; the files' paths are a
    third column, ``at_path``, then.
    """
    bounded_batches(docs.sparkSession)
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if not (plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.simpleString(1000).split("]")[-1]):
        docs = docs.select(*keep) if keep else docs
        if into:
            docs.write.parquet(into)
            docs = docs.sparkSession.read.schema(docs.schema).parquet(into)
        else:
            docs = settled(docs, "located")
    names = []
    for name in ("at_file", "at_row"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    place = docs.metadataColumn("_metadata")
    file, row = F.xxhash64(place["file_path"]), place["row_index"]
    path = [place["file_path"].alias("at_path")] if into else []
    return docs.select(*(keep or ["*"]), file.alias(names[0]), row.alias(names[1]), *path), *names


def skew_joined(rows: DataFrame, found: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join with a table that has one row a key and, in ``count``, how many of ``rows`` have that key.

    Hot keys (at most ``HOT_SHARE`` by their definition) are broadcast, so their
    rows stay where they are; the others are joined by a shuffle.
    """
    total = found.agg(F.sum(count)).head()[0] or 0
    least = max(LEAST_HOT, total // HOT_SHARE)
    hot = found.filter(F.col(count) >= least)
    if hot.isEmpty():
        return rows.join(found, keys)
    rare = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(found.filter(F.col(count) < least), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rare)


def without_rows(docs: DataFrame, at: tuple[str, str], dropped: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows whose place isn't in ``dropped`` (two columns, as ``at`` of docs); up to ``most`` places (some 60 MB as a hash table) are broadcast."""
    dropped = settled(dropped.toDF("gone_file", "gone_row"), "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= most else dropped
    return docs.join(dropped, (docs[at[0]] == dropped["gone_file"]) & (docs[at[1]] == dropped["gone_row"]), "left_anti").drop(*at)
