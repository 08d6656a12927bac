"""Documents that arrive as files of a stream, parsed and translated batch by batch.

An addition to the batch pipeline: the same plan runs on each micro-batch, and
the store's anti-join makes a batch that runs twice harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import segments, store, transform
from ..sources.textmd import text_blocks


def translate_arrivals(spark: SparkSession, folder: str, schema: str, pair: str, make: Callable[[], transform.Translate], store_path: str, checkpoint: str) -> StreamingQuery:
    """Append the translations of all new rows (doc_id, text) of a folder of Parquet files to the store, then stop."""

    def batch(rows: DataFrame, number: int) -> None:
        docs = rows.withColumn("sha256", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
        keyed = text_blocks(docs, "sha256").withColumnRenamed("doc_id", "sha256").withColumn("pair", F.lit(pair)).dropDuplicates(store.KEY)
        left = store.pending(keyed, store.stored(rows.sparkSession, store_path, pair), pair)
        segments.committed(left, make, store_path, store.next_commit(rows.sparkSession, store_path)).write.format("noop").mode("overwrite").save()

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
