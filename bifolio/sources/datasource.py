"""Files of folders as a Spark data source, for batches and streams: ``spark.read.format("document_files")``.

A row a file: path, name, suffix, sha256, content, as ``files.scan`` gives them, so
``files.parse`` takes them as they are. Files are dealt to tasks by their bytes, empty
ones among them, and read there through Arrow's file systems, in batches bounded by
bytes. Names and sizes are all that the driver sees.

A stream's batch has all files whose time of change and name come after those of the
batch before, dealt to tasks in the same way; a file that appears later with an earlier
time isn't seen.

Options: ``path`` (load's argument) or ``paths`` (a JSON list), ``partitionBytes``.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.shared import opened

NAME = "document_files"
SCHEMA = "path string, name string, suffix string, sha256 string, content binary"
ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("suffix", pa.string()), ("sha256", pa.string()), ("content", pa.binary())])
#: A file counts as so many bytes more than it has; a batch of rows has about so many.
OPEN_BYTES, BATCH_BYTES, PARTITION_BYTES = 1 << 16, 16 << 20, 64 << 20
_SUFFIX = re.compile(r"[^/](\.[^./]+)$")


class Files(InputPartition):
    """What one task reads: (folder given, path within its file system) of each file."""

    def __init__(self, files: list[tuple[str, str]]) -> None:
        super().__init__(0)
        self.files = files


def folders(options: dict[str, str]) -> list[str]:
    found = json.loads(options["paths"]) if "paths" in options else [options["path"]] if "path" in options else []
    if not found:
        raise ValueError("name a folder or a file: load(path), or the option paths")
    return found


def listed(paths: list[str]) -> list[tuple[int, str, str, int]]:
    """(time of change, folder, path, size) of all files below, in that order; hidden ones are left out, as Spark does."""
    from pyarrow import fs

    out = []
    for folder in paths:
        store, root = opened(folder)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(folder)
        below = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        for f in below:
            inner = f.path[len(root) :] if f is not info else f.base_name
            if f.type == fs.FileType.File and not any(part.startswith((".", "_")) for part in inner.split("/") if part):
                out.append((f.mtime_ns or 0, folder, f.path, f.size or 0))
    return sorted(out)


def dealt(files: list[tuple[int, str, str, int]], each: int) -> list[Files]:
    """The files in pieces of about ``each`` bytes."""
    out: list[Files] = []
    some: list[tuple[str, str]] = []
    size = 0
    for _, folder, path, bytes_ in files:
        if some and size + bytes_ + OPEN_BYTES > each:
            out.append(Files(some))
            some, size = [], 0
        some.append((folder, path))
        size += bytes_ + OPEN_BYTES
    return [*out, Files(some)] if some else out


def uri(folder: str, path: str) -> str:
    """A file's path in the form that Spark's own readers give."""
    scheme = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", folder)
    if not scheme:
        return f"file:{path}"
    if scheme[0].startswith("file:"):
        return f"file:{path}"
    return scheme[0].rstrip("/") + "/" + path.lstrip("/") if scheme[0].split(":")[0] in ("hdfs", "viewfs") else f"{scheme[0].split(':')[0]}://{path}"


def contents(part: Files) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    size, stores = 0, {}
    for folder, path in part.files:
        store = stores.get(folder) or stores.setdefault(folder, opened(folder)[0])
        with store.open_input_stream(path) as f:
            data = f.read()
        name = posixpath.basename(path)
        suffix = _SUFFIX.search(path)
        rows.append({"path": uri(folder, path), "name": name, "suffix": suffix[1].lower() if suffix else "", "sha256": hashlib.sha256(data).hexdigest(), "content": data})
        size += len(data)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, ARROW)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, ARROW)


class FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths, self.each = folders(options), int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        return dealt(listed(self.paths), self.each) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return contents(partition)


class FileStream(DataSourceStreamReader):
    """Offsets are the time, folder and path of the last file that was read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.paths, self.each = folders(options), int(options.get("partitionBytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {"time": -1, "folder": "", "path": ""}

    def latestOffset(self) -> dict:
        return next((dict(zip(("time", "folder", "path"), f, strict=False)) for f in reversed(listed(self.paths))), self.initialOffset())

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = ((x["time"], x["folder"], x["path"]) for x in (start, end))
        return dealt([f for f in listed(self.paths) if first < f[:3] <= last], self.each)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return contents(partition)

    def commit(self, end: dict) -> None:
        pass


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(self.options)

    def streamReader(self, schema) -> FileStream:
        return FileStream(self.options)


def scan(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """The files of some folders, for ``files.parse``."""
    spark.dataSource.register(DocumentFiles)
    return spark.read.format(NAME).options(paths=json.dumps(list(paths)), **options).load()


def scan_stream(spark: SparkSession, *paths: str, **options) -> DataFrame:
    """The same as a stream of what arrives."""
    spark.dataSource.register(DocumentFiles)
    return spark.readStream.format(NAME).options(paths=json.dumps(list(paths)), **options).load()
