"""Files of any supported format as documents and numbered blocks.

One scan of the files' bytes; each format takes its branch, and a file that
can't be read ends as a row with an ``error``, not as a failed job.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import decoded, is_utf8, stem, suffix
from ..operators import layout
from ..schema import HEADING, PARAGRAPH
from . import docx, epub, pdf
from .blocks import BLOCK
from .errors import ReadError
from .textmd import text_blocks

FORMATS = (".txt", ".md", ".epub", ".docx", ".pdf")
NOT_UTF8 = "El fichero no está en UTF-8; se ha leído como cp1252 y puede haber caracteres sustituidos."
#: Files go to Python in batches of about so many bytes, or one by one if larger.
ARROW_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches where the session has no bound of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "-1", str((1 << 31) - 1), "268435456"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """path, suffix, name, sha256 and content of files or folders."""
    bounded_batches(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    # the scan leaves out files without a byte; the listing has them
    listed = spark.createDataFrame([(unquote(f).replace("file:///", "file:/", 1),) for f in found.inputFiles()], "path string")
    empty = listed.join(found.select("path"), "path", "left_anti").withColumn("content", F.lit(b""))
    found = found.select("path", "content").unionByName(empty)
    return found.select("path", name_of(F.col("path")).alias("name"), suffix(F.col("path")).alias("suffix"), F.sha2("content", 256).alias("sha256"), "content")


def reader(read: Callable, kind: str, *more: Column) -> Column:
    """(error, found) of each file: what ``read`` makes of its name, content and other columns; whatever goes wrong in it is the file's error."""

    def one(name: str, content: bytes, *rest) -> tuple[str | None, object]:
        try:
            return None, read(name, content, *[list(x) for x in rest])
        except ReadError as e:
            return str(e), None
        except Exception as e:  # a damaged file must not end the job
            return f"«{name}» no se puede leer: {type(e).__name__}: {e}", None

    @F.pandas_udf(f"struct<error:string,found:array<{kind}>>")
    def run(*columns: pd.Series) -> pd.DataFrame:
        done = [one(*x) for x in zip(*columns, strict=True)]
        return pd.DataFrame({"error": pd.Series([e for e, _ in done], dtype=object), "found": pd.Series([None if e else [x] for e, x in done], dtype=object)})

    return run("name", "content", *more)


def parse(files: DataFrame) -> DataFrame:
    """One row a file: what is known of it, and what its reader found, as ``text``, ``chapters``, ``body`` or ``pages``; others are null.

    Formats are told apart by suffix, and each has its branch of the plan.
    """
    known = files.select("path", "name", "suffix", "sha256", "content", F.upper(F.regexp_replace("suffix", r"^\.", "")).alias("format"), stem(F.col("path")).alias("title"))
    kinds = {"warnings": "array<string>", "error": "string", "text": "string", "chapters": f"array<struct<title:string,blocks:array<{BLOCK}>>>", "body": docx.BODY, "pages": pdf.LAYOUT}

    def branch(rows: DataFrame, **found: Column) -> DataFrame:
        columns = [found.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
        return rows.select(F.col("path").alias("doc_id"), "path", "sha256", "format", "title", *columns)

    def of(*suffixes: str) -> DataFrame:
        return known.filter(F.col("suffix").isin(*suffixes))

    content, none = F.col("content"), F.array().cast("array<string>")
    text = branch(of(".txt", ".md"), text=decoded(content), warnings=F.when(is_utf8(content), none).otherwise(F.array(F.lit(NOT_UTF8))))
    word = branch(of(".docx").withColumn("r", reader(docx.body, docx.BODY)), body=F.get("r.found", F.lit(0)), error=F.col("r.error"), warnings=none)
    laid = branch(of(".pdf").withColumn("r", reader(pdf.layout, pdf.LAYOUT)), pages=F.get("r.found", F.lit(0)), error=F.col("r.error"), warnings=F.when(F.col("r.error").isNull(), F.array(F.lit(layout.LIMITED))).otherwise(none))
    book = of(".epub").withColumn("p", reader(epub.package, epub.PACKAGE)).withColumn("wanted", F.coalesce(epub.spine(F.get("p.found", F.lit(0))), F.array()))
    members = F.transform(F.filter("wanted", lambda i: i["present"]), lambda i: i["member"])
    book = book.withColumn("r", reader(epub.read, f"array<array<{BLOCK}>>", members)).withColumn("made", epub.chapters(F.col("wanted"), F.get("r.found", F.lit(0))))
    empty = F.when(F.size("made") == 0, F.concat(F.lit("«"), "name", F.lit("»: no se ha encontrado texto en el EPUB.")))
    book = branch(book, chapters=F.col("made"), error=F.coalesce("p.error", "r.error", empty), warnings=epub.warnings(F.col("wanted")))
    unknown = F.concat(F.lit("formato no soportado «"), "suffix", F.lit(f"»; se admiten: {', '.join(FORMATS)}"))
    rest = branch(known.filter(~F.col("suffix").isin(*FORMATS)), error=unknown, warnings=none)
    return text.unionByName(book).unionByName(word).unionByName(laid).unionByName(rest)


def tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chapters, blocks) of parsed files; a document's id is its path, and a chapter's index is its place among those with blocks."""
    flat = text_blocks(parsed.filter("text is not null").select("doc_id", "text"))
    of_word = parsed.filter("body is not null").select("doc_id", "title", docx.blocks(F.col("body")).alias("blocks"))
    nested = parsed.filter("chapters is not null and error is null").select("doc_id", F.posexplode("chapters").alias("chapter_idx", "c")).select("doc_id", "chapter_idx", "c.*")
    nested = nested.unionByName(of_word.filter(F.size("blocks") > 0).select("doc_id", F.lit(0).alias("chapter_idx"), "title", "blocks"))
    pages = parsed.filter("pages is not null")
    laid = layout.numbered(pages)
    readable = laid.filter(F.col("kind") == PARAGRAPH).select("doc_id").distinct()
    blocks = flat.unionByName(nested.select("doc_id", "chapter_idx", F.posexplode("blocks").alias("block_idx", "b")).select("doc_id", "chapter_idx", "block_idx", "b.*")).unionByName(laid.join(readable, "doc_id", "left_semi"))

    single = parsed.filter("text is not null").select("doc_id", F.lit(0).alias("chapter_idx"), "title").unionByName(pages.join(readable, "doc_id", "left_semi").select("doc_id", F.lit(0).alias("chapter_idx"), "title"))
    chapters = single.unionByName(nested.select("doc_id", "chapter_idx", "title"))

    scanned = layout.scanned_documents(pages)
    found = parsed.drop("text", "chapters", "pages").join(scanned, "doc_id", "left").join(readable.withColumn("readable", F.lit(True)), "doc_id", "left")
    looks = F.when(F.col("n_scanned") > 0, " (parece escaneado; OCR fuera del alcance).").otherwise(".")
    no_text = F.when((F.col("format") == "PDF") & F.col("readable").isNull(), F.concat(F.lit("«"), name_of(F.col("path")), F.lit("»: el PDF no tiene capa de texto extraíble"), looks))
    no_word = F.when(F.col("body").isNotNull() & (F.size(docx.blocks(F.col("body"))) == 0), F.concat(F.lit("«"), name_of(F.col("path")), F.lit("»: el DOCX no contiene texto.")))
    warnings = F.when(F.col("n_scanned") > 0, F.concat("warnings", F.array(layout.scanned_warning(F.col("n_scanned"), F.col("first_pages"))))).otherwise(F.col("warnings"))
    documents = found.select("doc_id", "path", "sha256", "format", "title", warnings.alias("warnings"), F.coalesce("error", no_text, no_word).alias("error"))
    return documents, chapters, blocks


def read(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chapters, blocks) of scanned files. Write what ``parse`` gives and pass it to ``tables`` to read each file once only."""
    return tables(parse(files))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def chapter_titles(blocks: DataFrame, default: DataFrame) -> DataFrame:
    """Each chapter's title: its first heading, or else the one that ``default`` (doc_id, chapter_idx, title) has."""
    first = blocks.filter(F.col("kind") == HEADING).groupBy("doc_id", "chapter_idx").agg(F.min_by("text", "block_idx").alias("heading"))
    return default.join(first, ["doc_id", "chapter_idx"], "left").select("doc_id", "chapter_idx", F.coalesce("heading", "title").alias("title"))


def dense(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, spine_pos, pos, kind, ...) without empty texts and chapters, numbered without gaps."""
    left = blocks.filter("text <> ''")
    at = Window.partitionBy("doc_id").orderBy("spine_pos")
    inner = Window.partitionBy("doc_id", "spine_pos").orderBy("pos")
    return left.withColumn("chapter_idx", F.dense_rank().over(at) - 1).withColumn("block_idx", F.row_number().over(inner) - 1)


def raise_error(documents: DataFrame) -> None:
    """Raise the error of a single-file job."""
    for r in documents.filter("error is not null").select("error").take(1):
        raise ReadError(r["error"])
