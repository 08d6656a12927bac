"""Volume, samples and omissions of documents, from their blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once, thousands, word_count
from ..schema import MARKER, MARKERS, PARAGRAPH, SAMPLE_CHARS, TRANSLATABLE

# How omissions are named in the summary.
OMITTED = ("imagen(es)", "tabla(s)", "nota(s)")


def translatable() -> Column:
    return F.col("kind").isin(*TRANSLATABLE)


def volume(blocks: DataFrame, chapters: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """words, paragraphs, translatable (and chapters) by key; documents without blocks count if chapters has them."""
    words = F.sum(F.when(translatable(), word_count(F.col("text"))).otherwise(0))
    got = blocks.groupBy(*keys).agg(words.alias("words"), F.count_if(F.col("kind") == PARAGRAPH).alias("paragraphs"), F.count_if(translatable()).alias("translatable"))
    if chapters is None:
        return got
    counted = chapters.groupBy(*keys).agg(F.count(F.lit(1)).alias("chapters")).join(got, list(keys), "left")
    return counted.select(*keys, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("words", "paragraphs", "translatable", "chapters")])


def volume_of(blocks: Column, chapters: Column) -> Column:
    """The same of blocks (kind, text) that are an array in their document's row: a struct, without a shuffle."""

    def counted(found: Column) -> Column:
        real = F.filter(found, lambda b: b["kind"].isin(*TRANSLATABLE))
        words = F.aggregate(F.transform(real, lambda b: word_count(b["text"])), F.lit(0).cast("long"), lambda n, x: n + x)
        paragraphs = F.size(F.filter(found, lambda b: b["kind"] == PARAGRAPH)).cast("long")
        return F.struct(words.alias("words"), paragraphs.alias("paragraphs"), F.size(real).cast("long").alias("translatable"), chapters.cast("long").alias("chapters"))

    return once(blocks, counted)


def sample_text(blocks: DataFrame, limit: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id and the first translatable texts, by lines, until ``limit`` characters are reached; cut to the limit.

    As no block is empty, those past the first ``limit`` of a chapter and what is past
    ``limit`` characters of a block don't matter; they go before the shuffle.
    """
    head = blocks.filter(translatable() & (F.col("block_idx") < limit)).select("doc_id", "chapter_idx", "block_idx", F.substring("text", 1, limit).alias("text"))
    # numbers of blocks count markers too, so a chapter's first translatable ones may lie further on if it has many markers
    late = blocks.filter(F.col("block_idx") >= limit).join(blocks.filter(~translatable()).select("doc_id", "chapter_idx").distinct(), ["doc_id", "chapter_idx"], "left_semi")
    head = head.unionByName(late.filter(translatable()).select("doc_id", "chapter_idx", "block_idx", F.substring("text", 1, limit).alias("text")))
    texts = head.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chapter_idx", "block_idx", "text"))).alias("x"))
    return texts.select("doc_id", first_texts(F.transform("x", lambda e: e["text"]), limit).alias("sample"))


def first_texts(texts: Column, limit: int = SAMPLE_CHARS) -> Column:
    """The sample of texts that are in one row: folded until the limit is reached, joined by line feeds and cut."""
    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n"))
    taken = F.aggregate(F.transform(texts, lambda t: F.length(t)), start, lambda acc, n: F.when(acc["chars"] >= limit, acc).otherwise(F.struct((acc["chars"] + n).alias("chars"), (acc["n"] + 1).alias("n"))))
    return F.substring(F.array_join(F.slice(texts, F.lit(1), taken["n"]), "\n"), 1, limit)


def omitted(blocks: DataFrame) -> DataFrame:
    """doc_id, one count a marker, and the summary text (null if nothing was left out)."""
    counts = [F.count_if((F.col("kind") == MARKER) & (F.col("text") == m)).alias(c) for m, c in zip(MARKERS, ("images", "tables", "notes"), strict=True)]
    got = blocks.groupBy("doc_id").agg(*counts)
    parts = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat_ws(" ", F.col(c).cast("string"), F.lit(name))) for c, name in zip(("images", "tables", "notes"), OMITTED, strict=True)]))
    return got.withColumn("summary", F.when(F.size(parts) > 0, F.concat(F.lit("elementos omitidos con marca en el HTML: "), F.array_join(parts, ", "))))


def line_of() -> Column:
    """The console line of a document's volume, in its row."""
    chapters = F.concat(F.col("chapters").cast("string"), F.when(F.col("chapters") == 1, " capítulo").otherwise(" capítulos"))
    return F.concat(F.lit("Volumen: "), thousands(F.col("words")), F.lit(" palabras · "), thousands(F.col("paragraphs")), F.lit(" párrafos · "), chapters)


def volume_line(volumes: DataFrame) -> DataFrame:
    """The console line of a document's volume."""
    return volumes.select("doc_id", line_of().alias("line"))


def summary(documents: DataFrame, volumes: DataFrame) -> DataFrame:
    """doc_id, words, paragraphs, chapters and all warnings."""
    return documents.join(volumes, "doc_id", "left").select("doc_id", "words", "paragraphs", "chapters", "warnings", "error")
