"""Aligned original and translation as HTML, one file a document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape
from ..schema import HEADING, MARKER
from .shared import opened

STYLE = "body{max-width:70rem;margin:2rem auto;font-family:serif}table{width:100%;border-collapse:collapse}td{width:50%;vertical-align:top;padding:.4rem .8rem}.fila-marca{text-align:center;font-style:italic}.enc-orig,.enc-trad{display:block}.enc-orig{font-weight:bold}"


def row(source: Column, target: Column) -> Column:
    """A block with its translation ``t`` as a table row."""
    text = escape(F.coalesce("t", F.lit("")), quotes=True)
    original = F.when(F.coalesce(F.col("html"), F.lit("")) != "", F.col("html")).otherwise(escape(F.col("text"), quotes=True))
    src, dst = escape(source, quotes=True), escape(target, quotes=True)
    marker = F.concat(F.lit('<tr class="fila-marca"><td colspan="2">'), escape(F.col("text"), quotes=True), F.lit("</td></tr>"))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.col("level"))).cast("string")
    heading = F.concat(F.lit('<tr class="fila-encabezado nivel-'), level, F.lit('"><td colspan="2"><span class="enc-orig" lang="'), src, F.lit('">'), original, F.lit('</span><span class="enc-trad" lang="'), dst, F.lit('">'), text, F.lit("</span></td></tr>"))
    pair = F.concat(F.lit('<tr><td lang="'), src, F.lit('">'), original, F.lit('</td><td lang="'), dst, F.lit('">'), text, F.lit("</td></tr>"))
    return F.when(F.col("kind") == MARKER, marker).when(F.col("kind") == HEADING, heading).otherwise(pair)


def aligned(blocks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """All blocks, each with its translation or null: as many rows as blocks."""
    return blocks.join(done.select(*keys, "t"), keys, "left")


def rows(blocks: DataFrame, source: Column, target: Column) -> DataFrame:
    return blocks.select("doc_id", "chapter_idx", "block_idx", row(source, target).alias("row"))


def bodies(rendered: DataFrame) -> DataFrame:
    """doc_id and its rows in order, by lines."""
    got = rendered.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chapter_idx", "block_idx", "row"))).alias("x"))
    return got.select("doc_id", F.array_join(F.transform("x", lambda e: e["row"]), "\n").alias("body"))


def pages(body: DataFrame, engine: str = "local") -> DataFrame:
    """doc_id and the whole page, of rows with title, source, target, pivot and body."""
    title, src, dst = (escape(F.col(c), quotes=True) for c in ("title", "source", "target"))
    note = F.when(F.col("pivot"), " · pivote por inglés").otherwise("")
    meta = F.concat(F.lit("Edición bilingüe "), F.upper(src), F.lit(" → "), F.upper(dst), note, F.lit(f" · traducción {engine}"))
    page = F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="'), src, F.lit('">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<title>'), title, F.lit(f" — edición bilingüe</title>\n<style>{STYLE}</style>\n</head>\n<body>\n<header>\n<h1>"), title,
        F.lit('</h1>\n<p class="meta">'), meta, F.lit("</p>\n</header>\n<table>\n<colgroup><col><col></colgroup>\n<thead><tr><th>Original ("), src, F.lit(")</th><th>Traducción ("), dst, F.lit(")</th></tr></thead>\n<tbody>\n"), F.col("body"), F.lit("\n</tbody>\n</table>\n</body>\n</html>\n"),
    )
    return body.select("doc_id", page.alias("html"))


def write_files(page: DataFrame, folder: str) -> DataFrame:
    """Write one file a document in a folder that all executors share; returns doc_id and path. Names are hashes of the ids, so none collide."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import uuid

        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            paths = []
            for doc, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name = f"{hashlib.sha256(str(doc).encode()).hexdigest()[:24]}.html"
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as o:
                    o.write((html or "").encode())
                store.move(part, f"{root}/{name}")
                paths.append(f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], ["doc_id", "path"])

    opened(folder)  # an error here rather than in tasks
    return page.select(F.col("doc_id").cast("string").alias("doc_id"), "html").mapInArrow(write, "doc_id string, path string")
