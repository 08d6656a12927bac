"""Folders that the driver and all executors share: through Hadoop's file systems on the driver, through Arrow's in tasks."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

#: Hadoop's names of stores that Arrow knows by another one.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file", "s3": "s3"}


def opened(uri: str):
    """(Arrow file system, folder) of a path that tasks write to; an error that says so where Arrow has no way to it."""
    from pyarrow import fs

    scheme = urlsplit(uri).scheme
    if not scheme:
        return fs.LocalFileSystem(), uri
    if scheme not in SCHEMES:
        raise ValueError(f"tasks can't write to {uri!r}: they know {', '.join(sorted(SCHEMES))} folders only")
    return fs.FileSystem.from_uri(SCHEMES[scheme] + uri[len(scheme) :])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names; a local session, such as one of a test, may go without that."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(found or 'file://' + tempfile.mkdtemp(prefix='shared-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(rows: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder, where they stay, and read again: for what is used more than once."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """(Hadoop file system, path)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = hadoop(spark, path)
    return bool(store.exists(at))


def names(spark: SparkSession, pattern: str) -> list[str]:
    """The names that a pattern matches; none where there is no such folder."""
    store, at = hadoop(spark, pattern)
    return [s.getPath().getName() for s in store.globStatus(at) or []]


def created(spark: SparkSession, path: str) -> bool:
    """Make an empty file; false where one exists already."""
    store, at = hadoop(spark, path)
    try:
        return bool(store.createNewFile(at))
    except Exception as e:  # some stores raise where others say no
        if store.exists(at):
            return False
        raise e


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        store, at = hadoop(spark, path)
        store.delete(at, True)
