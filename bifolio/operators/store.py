"""The resumable store of what has been translated.

Rows are appended, never changed; of several rows for one block the last wins, so a task
or batch that runs twice does no harm. Which is the last is told by the number of the
commit that wrote it: the store counts its commits itself, whoever makes them, so clocks
don't matter. The key holds the content's hash and the language pair, so other content
or another pair starts afresh. A finished job is ended by one row with a commit's
number: its rows up to that commit don't count any more.

The rows are a table in Parquet, in a folder a pair and dealt to buckets by the rest of the
key as Spark deals rows out itself. Reading one pair opens its folder alone, and the rows
are grouped and joined by their key where they lie, without a shuffle of the store. The
table is known to the session's catalog under a name made from its path. Tasks add to it
in segments of their own (``segments``), batches by ``append``.

    pair=<pair>/...<bucket>...parquet   rows
    _ended/                             (sha256, pair, seq) of jobs that ended
    _commits/<number>                   the commits' numbers
    _buckets-<number>                   how many buckets there are
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chapter_file
from ..schema import TRANSLATIONS
from .profile import translatable
from .shared import created, exists, names, opened, remove

KEY = ["sha256", "pair", "chapter_idx", "block_idx"]
#: What the buckets are made of; a pair has a folder.
PLACED = ["sha256", "chapter_idx", "block_idx"]
BUCKETS = 256
#: Up to so many ended jobs (some 100 bytes each) are sent to all executors; more are joined by a shuffle.
MOST_BROADCAST = 500_000
#: So many commits' numbers stay behind, for those who count at the same time.
KEPT_NUMBERS = 100


def last_wins(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.max_by("t", "seq").alias("t"))


def read_jsonl(spark: SparkSession, path: str, sha256: str, pair: str) -> DataFrame:
    """The translations of a job folder with files cap-NNN.jsonl; broken lines are skipped, the last line of a block wins.

    A folder whose meta.json names other content or another pair is stale: it is deleted, and counts as empty. One without it is taken as it is.
    """
    meta = _files(spark, f"{path}/meta.json")
    if meta is not None:
        try:
            found = json.loads("\n".join(r[0] for r in meta.collect()))  # one small file
        except json.JSONDecodeError:
            found = {}
        if not isinstance(found, dict) or (found.get("sha256"), found.get("pair")) != (sha256, pair):
            remove(spark, path)
            return spark.createDataFrame([], TRANSLATIONS).drop("seq")
    lines = _files(spark, f"{path}/cap-*.jsonl")
    if lines is None:
        return spark.createDataFrame([], TRANSLATIONS).drop("seq")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    entry = F.from_json("value", "b string, t string")
    # files go by their names, then lines by their place
    place = F.struct(name.alias("name"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    rows = lines.select(F.try_to_number(F.regexp_extract(name, r"cap-([0-9]+)[^/]*$", 1), F.lit("9999999999")).cast("int").alias("chapter_idx"), entry.alias("e"), place.alias("seq"))
    rows = rows.select(F.lit(sha256).alias("sha256"), F.lit(pair).alias("pair"), "chapter_idx", F.expr("try_cast(e.b as int)").alias("block_idx"), F.col("e.t").alias("t"), "seq")
    return last_wins(rows.filter("chapter_idx is not null and block_idx is not null and t is not null"))


def _files(spark: SparkSession, pattern: str) -> DataFrame | None:
    return spark.read.text(pattern) if names(spark, pattern) else None


def buckets(spark: SparkSession, path: str, fresh: int | None = None) -> int:
    """How many buckets the store at a path has; where there is none yet, one is made with ``fresh`` (or BUCKETS) of them."""
    found = names(spark, f"{path}/_buckets-*")
    if not found:
        created(spark, f"{path}/_buckets-{fresh or BUCKETS}")
        found = names(spark, f"{path}/_buckets-*")
    return int(min(found).rsplit("-", 1)[1])  # the same one for all who made it at once


def next_commit(spark: SparkSession, path: str) -> int:
    """A number that is larger than those of all commits before, and nobody else's."""
    have = sorted(map(int, names(spark, f"{path}/_commits/*")))
    number = (have or [0])[-1] + 1
    while not created(spark, f"{path}/_commits/{number}"):
        number += 1
    remove(spark, *(f"{path}/_commits/{n}" for n in have[:-KEPT_NUMBERS]))
    return number


def table(spark: SparkSession, path: str) -> str:
    """The name under which the session's catalog knows the store's rows, with all that was added since."""
    name = f"store_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:24]}"
    quoted = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (sha256 STRING, chapter_idx INT, block_idx INT, t STRING, seq BIGINT, pair STRING) USING parquet PARTITIONED BY (pair) CLUSTERED BY ({', '.join(PLACED)}) INTO {buckets(spark, path)} BUCKETS LOCATION '{quoted}'")
    spark.catalog.refreshTable(name)
    spark.catalog.recoverPartitions(name)
    return name


def append(rows: DataFrame, path: str) -> int:
    """Add rows (KEY, t) to the store as one commit, whose number is returned. Of rows of one block, the one with the largest ``seq`` counts, if they have that."""
    spark = rows.sparkSession
    number, n = next_commit(spark, path), buckets(spark, path)
    dealt = rows.repartition(n, *PLACED)
    dealt = last_wins(dealt) if "seq" in rows.columns else dealt.select(*KEY, "t")
    placed = dealt.select(*PLACED, "t", F.lit(number).cast("long").alias("seq"), "pair")
    placed.write.mode("append").format("parquet").partitionBy("pair").bucketBy(n, *PLACED).saveAsTable(table(spark, path))
    return number


def stored(spark: SparkSession, path: str, pair: str | None = None) -> DataFrame:
    """The last row of each block (KEY, t), but for those of jobs that have ended since; of one pair, if it is named."""
    if not exists(spark, path):
        return spark.createDataFrame([], TRANSLATIONS).drop("seq")
    rows, ended = spark.table(table(spark, path)), None
    if names(spark, f"{path}/_ended/*.parquet"):
        ended = spark.read.schema("sha256 string, pair string, seq long").parquet(f"{path}/_ended")
    if pair is not None:
        rows, ended = rows.filter(F.col("pair") == pair), ended.filter(F.col("pair") == pair) if ended is not None else None
    if ended is not None:
        last = ended.groupBy("sha256", "pair").agg(F.max("seq").alias("ended"))
        last = F.broadcast(last) if last.count() <= MOST_BROADCAST else last
        rows = rows.join(last, ["sha256", "pair"], "left").filter("ended is null or seq > ended")
    found = last_wins(rows)
    return found.withColumn("pair", F.lit(pair)) if pair is not None else found


def write_jsonl(rows: DataFrame, path: str, sha256: str, pair: str, file_name: str = "") -> None:
    """One job's rows (chapter_idx, block_idx, t) as a folder that ``read_jsonl`` reads: meta.json, which also names the file that was translated, and a file cap-NNN.jsonl a chapter with a line a block."""
    spark, line = rows.sparkSession, F.to_json(F.struct(F.col("block_idx").alias("b"), "t"))
    lines = rows.groupBy("chapter_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))  # a chapter is one file
    named = lines.select(chapter_file(F.col("chapter_idx")).alias("name"), F.concat("text", F.lit("\n")).alias("text"))
    meta = spark.createDataFrame([("meta.json", json.dumps({"fichero": file_name, "sha256": sha256, "pair": pair}, ensure_ascii=False, indent=2))], "name string, text string")
    opened(path)  # an error here rather than in tasks

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        store.create_dir(root, recursive=True)
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{name}") as o:
                    o.write(text.encode())
            yield b.select(["name"])

    named.unionByName(meta).mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def pending(blocks: DataFrame, done: DataFrame, pair: str | None = None) -> DataFrame:
    """Translatable blocks (with sha256 and pair) that the store lacks. Where all are of one pair that is named, the store's rows are joined where they lie."""
    wanted = blocks.filter(translatable())
    return wanted.join(done, KEY, "left_anti") if pair is None else wanted.join(done.drop("pair"), PLACED, "left_anti")


def resumed(blocks: DataFrame, done: DataFrame) -> DataFrame:
    """By document: translatable blocks, how many of them the store has, how many are left."""
    hit = blocks.filter(translatable()).join(done.select(*KEY, F.lit(1).alias("hit")), KEY, "left")
    return hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("translatable"), F.count("hit").alias("resumed"), F.count_if(F.col("hit").isNull()).alias("fresh"))


def discard(spark: SparkSession, path: str, contents: DataFrame, pair: str) -> int:
    """End the jobs of the contents (sha256) for a pair in one commit, however many they are; what is committed later starts afresh."""
    number = next_commit(spark, path)
    contents.select("sha256", F.lit(pair).alias("pair"), F.lit(number).cast("long").alias("seq")).write.mode("append").parquet(f"{path}/_ended")
    return number


def drop_if_empty(spark: SparkSession, path: str) -> None:
    """Delete a store in which no row counts any more."""
    if exists(spark, path) and stored(spark, path).isEmpty():
        forget(spark, path)
        remove(spark, path)


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Write what is left of a store, without ended jobs and rows that others replaced, as a new one."""
    append(stored(spark, path), into)


def forget(spark: SparkSession, path: str) -> None:
    """Take the store's table out of the session's catalog; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {table(spark, path)}")
