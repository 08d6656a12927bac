"""Token ids as length-delimited binary records with a separate offset index.

A records file holds one record a document, in ascending document id:

    uint64 length | uint32 masked crc32 of those 8 bytes | payload | uint32 masked crc32 of the payload

all little-endian; the payload is the document's ids as uint16 (vocabularies of
at most 65,536 ids) or uint32. The mask rotates a checksum right by 15 bits and
adds a constant, so that a checksum stored inside checksummed data stays
harmless. The index beside it has 20 bytes a record: int64 document id, uint64
offset of the record, uint32 number of ids, whose highest bit says that the record has
no document id. Files are read in stretches of some MB, so their size doesn't matter.
``read_shuffled`` opens the indexes
alone, puts their entries in random order and then reads single records.

Documents are dealt to files by ranges of (id, place in its file), so an id that
many rows have, or none, makes no large file. Tasks write files under names of their
own and return one manifest row a file; only files named in the manifest count, so a
task that is run again leaves no double records. There are ``MOST_FILES`` files at
most, larger ones if there is more, so the manifest is bounded.

Null text counts as empty (it has the end id alone). Null ids sort first.
Repeated rows are written as often as they come, in the order of their place among
equal ids. An empty table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_bytes, lean, located, shared_path
from .text_kernel import sliced

MASK_DELTA = 0xA282EAD8
FILE_BYTES, MOST_FILES = 24 << 20, 20_000
#: Bytes of remembered stretches, with about ``ENTRY_BYTES`` for each beside its text and ids; as much again is kept of the ones before.
REMEMBERED_BYTES, ENTRY_BYTES = 72 << 20, 200
NO_ID = np.uint32(1 << 31)
#: Index entries, and bytes of records, read at a time (and one record more at most).
READ_ENTRIES, READ_BYTES = 1 << 16, 8 << 20
#: What a record has beside its payload.
FRAME_BYTES = 16
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u4")])
MANIFEST = "bucket long, records string, index string, wide boolean, n_docs long, n_tokens long, n_bytes long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframed(data: memoryview, at: int) -> tuple[bytes, int]:
    """The payload of the record at an offset, and where the next one starts; raises on damage."""
    head = bytes(data[at : at + 8])
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked_crc(head):
        raise ValueError(f"damaged length at byte {at}")
    (size,) = struct.unpack("<Q", head)
    payload = bytes(data[at + 12 : at + 12 + size])
    if len(payload) < size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked_crc(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + 16 + size


class ChunkEncoder:
    """Encodes whole texts with a ``tokenizers`` tokenizer, remembering the ids of each stretch between single spaces.

    The byte-level split pattern has no lookbehind, and a space between two
    characters that aren't white space always starts a new word of it. So a
    text without two white-space characters in a row may be cut before its
    spaces, and the ids of the parts follow each other. Other texts are
    encoded in one go. ``most`` bounds the bytes of stretches remembered.
    """

    def __init__(self, path: str, most: int = REMEMBERED_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = len(vocabulary)
        #: bytes of text behind each id: in a byte-level vocabulary each character of a piece is one byte
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.width[i] = len(piece)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most, self.held = most, 0

    _runs = re.compile(r"\s\s")

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, stretches: list[str]) -> None:
        """Encode stretches, each as if a space stood before it, many in one text; the bytes behind the ids show where each ends."""
        parts = [stretches[i : i + 192] for i in range(0, len(stretches), 192)]
        for part, coded in zip(parts, self._plain([" " + " ".join(part) for part in parts]), strict=True):
            ends = np.cumsum(self.width[np.frombuffer(coded, "<u4")])
            want = np.cumsum([1 + len(x.encode()) for x in part])
            cut = np.searchsorted(ends, want) + 1
            if len(ends) and ends[-1] == want[-1] and np.array_equal(ends[cut - 1], want):
                cut = [0, *(4 * cut).tolist()]
                self._remember(zip(part, [coded[a:b] for a, b in zip(cut, cut[1:])], strict=False))
            else:  # an id doesn't stand for its own bytes here
                self._remember(zip(part, self._plain([" " + x for x in part]), strict=True))

    def _remember(self, found: Iterable[tuple[str, bytes]]) -> None:
        found = dict(found)
        self.known.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY_BYTES * len(found)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        cut: list[list[str] | None] = [None if self._runs.search(text) or text[:1].isspace() else text.split(" ") for text in texts]
        known = self.known
        if self.held > self.most:
            self.older, self.known, self.held = known, {}, 0
            known = self.known
        new = set()
        for parts in cut:
            if parts is not None:
                new.update(parts[1:])
        new.difference_update(known)
        if self.older and new:
            older = self.older
            again = {x: older[x] for x in new if x in older}
            self._remember(again.items())
            new.difference_update(again)
        self._learn(list(new))
        alone = iter(self._plain([text if parts is None else parts[0] for text, parts in zip(texts, cut, strict=True)]))
        return [next(alone) if parts is None else next(alone) + b"".join([known[x] for x in parts[1:]]) for parts in cut]


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The process's encoder for a vocabulary file; what it remembers serves later tasks too."""
    key = (os.getpid(), path)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path)
    return _ENCODERS[key]


def file_count(docs: DataFrame, each: int, least: int) -> int:
    return int(min(MOST_FILES, max(least, -(-input_bytes(docs) // each))))


def write_records(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, least_files: int = 8) -> list[dict]:
    """Write the records; returns the manifest, ordered by bucket, with ``start``: the number of ids in the files before."""
    rows, *at = located(docs, *dict.fromkeys((id_col, text_col)))
    narrow = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(at[0]).alias("file"), F.col(at[1]).alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("file"), F.col("row")]
    dealt = narrow.repartitionByRange(file_count(narrow, file_bytes, least_files), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encode = encoder(vocabulary)
        wide = encode.size > 1 << 16
        end = np.array([end_id], "<u4").tobytes()
        bucket = TaskContext.get().partitionId()  # the ranges' order
        name = f"part-{bucket:06d}-{uuid.uuid4().hex}"
        out, index, size, n_docs, n_tokens = None, None, 0, 0, 0
        for whole in batches:
            for batch in sliced(whole, "text", 1 << 21):
                if out is None:
                    out, index = store.open_output_stream(f"{root}/{name}.rec"), store.open_output_stream(f"{root}/{name}.idx")
                entries = []
                for doc, coded in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    coded += end
                    record = framed(coded if wide else np.frombuffer(coded, "<u4").astype("<u2").tobytes())
                    out.write(record)
                    n = len(coded) // 4
                    if n >= NO_ID:
                        raise ValueError(f"document {doc} has {n} ids, more than a record can")
                    entries.append((doc or 0, size, n | int(NO_ID) if doc is None else n))
                    size += len(record)
                    n_tokens += len(coded) // 4
                index.write(np.array(entries, INDEX).tobytes())
                n_docs += len(entries)
        if out is not None:
            out.close()
            index.close()
            row = (bucket, f"{folder}/{name}.rec", f"{folder}/{name}.idx", wide, n_docs, n_tokens, size)
            yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "records", "index", "wide", "n_docs", "n_tokens", "n_bytes"), row, strict=True))])

    manifest = sorted((r.asDict() for r in dealt.mapInArrow(lean(write), MANIFEST).collect()), key=lambda r: r["bucket"])  # one row a file: MOST_FILES at most
    start = 0
    for r in manifest:
        r["start"] = start
        start += r["n_tokens"]
    return manifest


def read_records(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start, ids of every record, read back in parallel, checksums verified."""
    return _read(spark, manifest, "doc_id long, start long, ids array<int>", lambda coded: coded.astype(np.int32).tolist())


def read_digests(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record."""
    return _read(spark, manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", None)


def _read(spark: SparkSession, manifest: list[dict], schema: str, ids) -> DataFrame:
    fields = [f.split()[0] for f in schema.split(", ")]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                kind, start, rows, size = np.dtype("<u4" if m["wide"] else "<u2"), m["start"], [], 0
                for index, data, base in _stretches(m["records"], m["index"], kind):
                    for none, doc, offset, n in zip(index["n"] >= NO_ID, index["doc_id"].tolist(), index["offset"].tolist(), (index["n"] & ~NO_ID).tolist(), strict=True):
                        payload, _ = unframed(data, offset - base)
                        coded = np.frombuffer(payload, kind)
                        if len(coded) != n:
                            raise ValueError(f"{m['records']}: the index has {n} ids at byte {offset}, the record {len(coded)}")
                        doc = None if none else doc
                        rows.append((doc, start, ids(coded)) if ids else (doc, start, n, zlib.crc32(coded.astype("<u4").tobytes())))
                        start += n
                        size += n
                        if len(rows) >= 5000 or (ids and size >= READ_BYTES // 16):
                            yield _batch(rows, fields, schema)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, fields, schema)

    return _files(spark, manifest).mapInArrow(lean(read), schema)


def _entries(index: str) -> Iterator[np.ndarray]:
    """A file's index, some entries at a time."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(index)
    with store.open_input_file(path) as f:
        while len(data := f.read(READ_ENTRIES * INDEX.itemsize)):
            yield np.frombuffer(data, INDEX)


def _stretches(records: str, index: str, kind: np.dtype) -> Iterator[tuple[np.ndarray, memoryview, int]]:
    """Consecutive records of a file: their index entries, their bytes, and where these begin in the file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(records)
    with store.open_input_file(path) as f:
        for entries in _entries(index):
            sizes = (entries["n"] & ~NO_ID).astype(np.int64) * kind.itemsize + FRAME_BYTES
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // READ_BYTES)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(entries)], strict=True):
                some = entries[a:b]
                base = int(some["offset"][0])
                yield some, memoryview(f.read_at(int(some["offset"][-1]) - base + int(sizes[b - 1]), base)), base


def _files(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    files = spark.createDataFrame([(m["records"], m["index"], m["wide"], m["start"]) for m in manifest], "records string, index string, wide boolean, start long")
    return files.repartition(max(1, len(manifest)))


def read_shuffled(spark: SparkSession, manifest: list[dict], seed: int = 0, partitions: int | None = None) -> DataFrame:
    """doc_id, ids of all records in a random order that the seed decides: the index entries are shuffled, and each record is read at its offset alone."""

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                for index in _entries(m["index"]):
                    for a in range(0, len(index), 10_000):
                        some = index[a : a + 10_000]
                        ids = pa.array(some["doc_id"].copy(), mask=some["n"] >= NO_ID)
                        yield pa.RecordBatch.from_arrays([ids, pa.array([m["records"]] * len(some), pa.string()), pa.array([m["wide"]] * len(some)), pa.array(some["offset"].astype(np.int64)), pa.array((some["n"] & ~NO_ID).astype(np.int64))], ["doc_id", "records", "wide", "offset", "n"])

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["records"] not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    store, path = fs.FileSystem.from_uri(r["records"])
                    opened[r["records"]] = store.open_input_file(path)
                kind = "<u4" if r["wide"] else "<u2"
                data = opened[r["records"]].read_at(FRAME_BYTES + r["n"] * np.dtype(kind).itemsize, r["offset"])
                payload, _ = unframed(memoryview(data), 0)
                rows.append((r["doc_id"], np.frombuffer(payload, kind).astype(np.int32).tolist()))
                if len(rows) >= 200:
                    yield _batch(rows, ["doc_id", "ids"], "doc_id long, ids array<int>")
                    rows = []
            if rows:
                yield _batch(rows, ["doc_id", "ids"], "doc_id long, ids array<int>")

    lot = F.xxhash64(F.lit(seed), "records", "offset")
    found = _files(spark, manifest).mapInArrow(entries, "doc_id long, records string, wide boolean, offset long, n long").withColumn("lot", lot)
    return found.repartition(partitions or max(1, len(manifest)), "lot").sortWithinPartitions("lot").drop("lot").mapInArrow(lean(pick), "doc_id long, ids array<int>")


def _batch(rows: list[tuple], fields: list[str], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], fields)


def token_records(docs: DataFrame, vocabulary: str, end_id: int = 0, **columns: str) -> DataFrame:
    """Write all documents' records in the shared folder and read them back as doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    return read_digests(spark, write_records(docs, vocabulary, shared_path(spark, "token-records"), end_id, **columns))
