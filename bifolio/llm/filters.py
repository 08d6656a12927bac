"""Operators as filters: documents in, the documents that stay out, all columns unchanged.

Decisions hold for rows, not ids: a row without an id, or with one that other rows
have too, stays or goes by its own text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, lean, located, without_rows
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .jaccard_join import PERCENT, SHINGLE, later_in_group, set_components
from .quality import learnt, statistics
from .text_kernel import sliced


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops the documents whose quality score is under ``least``; each row is scored where it is, and none is shuffled."""
    bounded_batches(docs.sparkSession)
    model = learnt(docs, labels, lambda i: crc_mod(i, 5) != 0, id_col, text_col)
    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, text_col, 1 << 20):
                yield batch.filter(pa.array(model.score(statistics(batch.column(batch.schema.get_field_index(text_col)))) >= least))

    return rows.mapInArrow(lean(run), rows.schema)


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keeps one row of each text: one of those with the largest id."""
    rows, *at = located(docs)
    found = exact_dedup(rows, id_col, text_col)
    return without_rows(rows, at, found.filter(~F.col("kept")).select("file", "row"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest id (rows without one come last)."""
    bounded_batches(docs.sparkSession)
    rows, *at = located(docs)
    return without_rows(rows, at, later_in_group(set_components(rows, id_col, text_col, shingle, percent)))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    rows, *at = located(docs)
    found = contamination(rows, benchmark, id_col=id_col, text_col=text_col)
    return without_rows(rows, at, found.filter("contaminated").select("file", "row"))
