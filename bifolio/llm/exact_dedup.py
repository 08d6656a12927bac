"""Exact deduplication with keyed state on disk.

A stream of (digest, id, locator) rows updates one state entry a digest: the
largest id seen, where its text is (a hash of its file's path, and the row in the
file), and how many rows came. The state lies in RocksDB, is checkpointed in the
shared folder and never expires, so later runs with the same ``checkpoint`` go on where
an earlier one ended. A digest alone is no proof: where rows hit an entry, the entry's
text is opened at its locator, and every distinct text of the hits is compared with
it byte by byte. The texts that hit are made distinct before they are shuffled, so
a text that a third of all rows have is sent once a task. Digests that two texts
share are dealt with by the texts themselves.

Beside a state that goes on lie the narrow rows of all its runs (``rows``), the paths
behind the hashes of files (``locators``) and copies of tables that don't come straight
from Parquet files (``copies``). So the texts of earlier runs are opened in the files
they came from, which have to be there still; a later run is an error without them.

Null text counts as empty; rows without text are therefore copies of each
other. Of equal texts the row with the largest id stays (null ids lose, and of
several rows with that id the one last in place stays), so exactly one row of each
text is ``kept``. An empty table gives an empty result. Columns other than the id
and the text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import located, settled, shared_path, skew_joined

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: So many digests of 32 bytes, or places of 16, (some 32 MB as a hash table) are sent to all executors; more are joined by a shuffle.
BROADCAST_DIGESTS = 300_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def texts_at(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: str | None = None) -> DataFrame:
    """doc_id, text, and the place of each row: file (a hash of its path), row. A table that doesn't come straight from Parquet files is copied, to ``copies`` if that is given; files' paths are a further column then."""
    found, file, row = located(docs, *dict.fromkeys((id_col, text_col)), into=copies)
    return found.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(file).alias("file"), F.col(row).alias("row"), *([F.col("at_path").alias("path")] if copies else []))


def state_rows(texts: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The narrow rows that the state needs: digest, id and where the text is."""
    return texts.select(digest(F.col("text")).alias("digest"), "doc_id", "file", "row")


def keyed_state(rows: DataFrame) -> DataFrame:
    """The stateful step, for a stream (or a batch) of ``state_rows``: entry and count of each digest."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("entry"), F.count(F.lit(1)).alias("group_size"))


def run_stream(spark: SparkSession, staged: str, schema, checkpoint: str, files_per_batch: int = 256) -> None:
    """Feed what is new in the folder ``staged`` to the state kept at ``checkpoint``."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))  # as many stores; a new session would have the default
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.maintenanceInterval", "5s")  # executors drop the stores soon after the stream ends
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "128")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(staged)
    query = keyed_state(stream).writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def state_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as rows: digest, entry (doc_id, file, row), group_size."""
    found = spark.read.format("statestore").load(checkpoint)
    entry, count = (f.name for f in found.schema["value"].dataType.fields)
    return found.select(F.col("key.digest").alias("digest"), F.col(f"value.{entry}").alias("entry"), F.col(f"value.{count}").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, digest, and its place: file, row."""
    spark, goes_on = docs.sparkSession, checkpoint is not None
    checkpoint = checkpoint or shared_path(spark, "dedup-state")
    texts = texts_at(docs, id_col, text_col, f"{checkpoint}/copies/{uuid.uuid4().hex}" if goes_on else None)
    own = f"{checkpoint}/rows/{uuid.uuid4().hex}"
    state_rows(texts, digest).write.parquet(own)
    staged = spark.read.schema(state_rows(texts, digest).schema).parquet(own)
    if goes_on:
        remember_paths(texts, text_col, checkpoint)
    elsewhere, known = (checkpoint, _known(spark, staged, checkpoint)) if goes_on else (None, None)
    if staged.inputFiles():
        run_stream(spark, f"{checkpoint}/rows/*", staged.schema, checkpoint)
        groups = settled(state_table(spark, checkpoint), "dedup-groups")
    else:
        groups = keyed_state(staged)
    clashing = clashes(texts, staged, groups, digest, elsewhere, known)
    if clashing is None:
        return decided(skew_joined(staged, groups, ["digest"], "group_size"))
    sound = skew_joined(staged, groups, ["digest"], "group_size").join(clashing, "digest", "left_anti")
    every = spark.read.schema(staged.schema).parquet(f"{checkpoint}/rows/*").join(_small(clashing), "digest", "left_semi")
    of_clash = settled(at_places(texts, every, elsewhere), "dedup-clash-texts")
    by_text = keyed_state(of_clash.withColumn("digest", F.struct("digest", "text"))).select("digest.*", "entry", "group_size")
    mine = of_clash.join(staged.join(_small(clashing), "digest", "left_semi").select("file", "row"), ["file", "row"], "left_semi")
    again = mine.join(by_text, ["digest", "text"]).drop("text")
    return decided(sound.unionByName(again.select(*sound.columns)))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def _known(spark: SparkSession, staged: DataFrame, checkpoint: str) -> tuple[DataFrame | None, DataFrame | None]:
    """What earlier runs say of the digests at hand: their entries before this run, and those that different texts shared then."""
    hit = staged.select("digest").distinct()
    entries = settled(state_table(spark, checkpoint).join(hit, "digest", "left_semi").select("digest", "entry"), "dedup-before") if _exists(spark, f"{checkpoint}/offsets") else None
    shared = spark.read.parquet(f"{checkpoint}/clashes").distinct().join(hit, "digest", "left_semi") if _exists(spark, f"{checkpoint}/clashes") else None
    return entries, shared


def remember_paths(texts: DataFrame, text_col: str, checkpoint: str) -> None:
    """Add the paths of a table's files, and the name of its column of texts, to those that a state knows."""
    files = texts.select("path", "file").groupBy("file").agg(F.first("path").alias("path"))
    files.withColumn("text_col", F.lit(text_col)).write.mode("append").parquet(f"{checkpoint}/locators")


def decided(rows: DataFrame) -> DataFrame:
    stays = (F.col("file") == F.col("entry.file")) & (F.col("row") == F.col("entry.row"))
    return rows.select("doc_id", F.col("entry.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "digest", "file", "row")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_DIGESTS else df


def at_places(texts: DataFrame, places: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """The rows of ``places`` (file, row and others) with the text that lies there: in the table at hand, or in files of earlier runs of the state at ``checkpoint``."""
    here = texts.select("file", "row", "text").join(places, ["file", "row"])
    if checkpoint is None:
        return here.select(*places.columns, "text")
    spark = texts.sparkSession
    others = places.join(F.broadcast(texts.select("file").distinct()), "file", "left_anti")  # files of one table
    known = spark.read.parquet(f"{checkpoint}/locators").dropDuplicates(["file"])
    found = here.select(*places.columns, "text")
    wanted = known.join(others.select("file").distinct(), "file").select("text_col", "path").collect()  # names of files alone, as Spark lists them to read them
    for text_col in sorted({r["text_col"] for r in wanted}):
        rows = spark.read.parquet(*[r["path"] for r in wanted if r["text_col"] == text_col])
        place = rows.metadataColumn("_metadata")
        there = rows.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row"))
        found = found.unionByName(there.join(others, ["file", "row"]).select(*places.columns, "text"))
    return found


def opened(texts: DataFrame, entries: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """The texts at the locators of entries: digest, entry_text."""
    return at_places(texts, _small(entries.select("digest", "entry.file", "entry.row")), checkpoint).select("digest", F.col("text").alias("entry_text"))


def clashes(texts: DataFrame, staged: DataFrame, groups: DataFrame, digest: Callable[[Column], Column], checkpoint: str | None = None, known: tuple[DataFrame | None, DataFrame | None] | None = None) -> DataFrame | None:
    """Digests under which different texts lie, found by comparing each text that hits with the whole text of its entry; None if there are none.

    Where a state goes on, ``known`` has its entries before this run, which this run's rows
    may have replaced, so texts are compared with these too, and the clashes of earlier runs.
    """
    before, shared = known or (None, None)
    many = groups.filter("group_size > 1")
    if checkpoint is not None:  # the state knows digests of earlier runs that no row has now
        many = settled(many.join(staged.select("digest").distinct(), "digest", "left_semi"), "dedup-hit")
    few = many.count()
    if not few:
        return None
    if few <= BROADCAST_DIGESTS:
        hits = texts.withColumn("digest", digest(F.col("text"))).join(F.broadcast(many.select("digest")), "digest", "left_semi")
    else:
        hits = texts.join(skew_joined(staged, many, ["digest"], "group_size").select("file", "row", "digest"), ["file", "row"])
    entries = opened(texts, many, checkpoint)
    if before is not None:
        entries = entries.unionByName(opened(texts, before, checkpoint))
    apart = hits.select("digest", "text").distinct().join(entries, "digest").filter(F.col("text") != F.col("entry_text")).select("digest")
    bad = settled(apart if shared is None else apart.unionByName(shared), "dedup-clashes").distinct()
    if bad.isEmpty():
        return None
    if checkpoint is not None:
        bad.write.mode("append").parquet(f"{checkpoint}/clashes")
    return bad
