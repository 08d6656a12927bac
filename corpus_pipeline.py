"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet in the shared folder and read again as the next one's
docs. All but the last return the columns of documents.

A document goes if its quality score is under 0.3, if its text has an exact copy
with a larger id, if it is linked to a document with a smaller id by a Jaccard
similarity of at least 0.8 of their sets of five-word shingles (op6 has a rule
of its own), or if it holds a passage of the benchmark. The last stage returns
doc_id, n_tokens and ids of the others. Rows without an id, or with one that other
rows have too, stay or go by their own text; of linked documents that with the
smallest id stays, one without an id last. ``run`` deletes what a stage has written in
the shared folder when it is done, and its result when the next one is; the last one's
result stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bifolio.llm import filters
from bifolio.llm.common import removed, shared_path, table, temporary
from bifolio.llm.queries import tokenizer_file
from bifolio.llm.sentence_pieces import encoded

NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filters.good_documents(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filters.distinct_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filters.one_of_each_group(docs, shingle=NEAR_SHINGLE, percent=NEAR_PERCENT)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filters.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("exact copies", exact_copies), ("near copies", near_copies), ("benchmark passages", benchmark_passages), ("tokens", tokens)]

#: SQL can't express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name.replace(' ', '-')}")
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        removed(spark, *before)
        docs, before = spark.read.parquet(path), [path]
    return docs
