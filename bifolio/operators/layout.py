r"""From a page's layout to paragraphs.

Lines of a layout block are joined, undoing hyphenation; blocks inside tables
give way to one marker a table; page numbers go; and paragraphs that a column
or page break cut are merged. All of it looks at a line's or block's neighbours alone,
so it is done on arrays within a document's row, in linear time and without a shuffle;
``join_lines``, ``merge_fragments`` and ``layout_blocks`` are for lines and blocks that
come as rows, and only gather them first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, collapse, once, styled
from ..schema import MARK_IMAGE, MARK_TABLE, MARKER, PARAGRAPH

# What ends a sentence, and what starts in the middle of one.
ENDS = r"[.!?:;…»”\"'][{ws}]*$"
LOWER = "a-záéíóúüñàèìòùâêîôûäëïöç"
PAGE_NUMBER = r"^\p{Nd}{1,4}$"
LIMITED = "PDF: fidelidad limitada — la división en párrafos es heurística, no se detectan encabezados y las imágenes y tablas se pierden (quedan sus marcas)."


def _ends_sentence(text: Column) -> Column:
    return text.rlike(ENDS.replace("{ws}", WS))


def _starts_lower(text: Column) -> Column:
    return text.rlike(f"^[{LOWER}]")


def scanned_warning(n: Column, first: Column) -> Column:
    """The warning for n pages without a text layer, the first of which are named."""
    more = F.when(n > F.size(first), "…").otherwise("")
    return F.concat(F.lit("PDF: "), n.cast("string"), F.lit(" página(s) sin capa de texto omitida(s) (¿escaneadas?): "), F.array_join(first.cast("array<string>"), ", "), more, F.lit(". OCR fuera del alcance."))


def _indices(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def joined(lines: Column) -> Column:
    """(text, html) of lines (plain, html) as one paragraph; a hyphen before a lower-case letter joins."""
    real = F.filter(F.transform(lines, lambda x: F.struct(collapse(x["plain"]).alias("p"), F.trim(x["html"]).alias("h"))), lambda x: x["p"] != "")

    def glued(all_lines: Column, i: Column) -> Column:
        """Whether a line goes on with the word that the one before it has cut."""
        return F.coalesce(F.get(all_lines, i - 1)["p"].endswith("-") & _starts_lower(F.get(all_lines, i)["p"]), F.lit(False)) & (i > 0)

    def parts(found: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            cut, sep = glued(found, i + 1), F.when(glued(found, i), "").otherwise(" ")
            return F.struct(F.concat(sep, F.when(cut, F.regexp_replace(x["p"], "-$", "")).otherwise(x["p"])).alias("p"), F.concat(sep, F.when(cut, F.regexp_replace(x["h"], "-((?:</[bi]>)*)$", "$1")).otherwise(x["h"])).alias("h"))

        return F.transform(found, part)

    def whole(x: Column) -> Column:
        marked = F.trim(F.array_join(F.transform(x, lambda e: e["h"]), ""))
        marked = F.replace(F.replace(marked, F.lit("</i> <i>"), F.lit(" ")), F.lit("</b> <b>"), F.lit(" "))
        return F.struct(collapse(F.array_join(F.transform(x, lambda e: e["p"]), "")).alias("text"), collapse(marked).alias("html"))

    return once(once(real, parts), whole)


def merged(blocks: Column) -> Column:
    """Blocks (kind, text, html) with neighbouring paragraphs merged, after a hyphen or where no sentence ends and a lower-case letter follows; and of how many parts each is."""

    def goes_on(all_blocks: Column, x: Column, i: Column) -> Column:
        before = F.get(all_blocks, i - 1)
        both = (x["kind"] == PARAGRAPH) & (before["kind"] == PARAGRAPH)
        return (i > 0) & F.coalesce(both & (before["text"].endswith("-") | (~_ends_sentence(before["text"]) & _starts_lower(x["text"]))), F.lit(False))

    def islands(found: Column) -> Column:
        starts = F.filter(F.transform(found, lambda x, i: F.when(~goes_on(found, x, i), i)), lambda i: i.isNotNull())
        return once(starts, lambda at: F.transform(at, lambda start, k: island(found, start, F.coalesce(F.get(at, k + 1), F.size(found)))))

    def island(found: Column, start: Column, end: Column) -> Column:
        def part(i: Column) -> Column:
            x, cut = F.get(found, i), (i + 1 < end) & F.get(found, i)["text"].endswith("-")
            sep = F.when((i == start) | F.coalesce(F.get(found, i - 1)["text"].endswith("-"), F.lit(False)), "").otherwise(" ")
            return F.struct(F.concat(sep, F.when(cut, F.regexp_replace(x["text"], "-$", "")).otherwise(x["text"])).alias("t"), F.concat(sep, F.when(cut, F.regexp_replace(x["html"], "-((?:</[bi]>)*)$", "$1")).otherwise(x["html"])).alias("h"))

        def whole(x: Column) -> Column:
            return F.struct(F.get(found, start)["kind"].alias("kind"), F.array_join(F.transform(x, lambda e: e["t"]), "").alias("text"), F.array_join(F.transform(x, lambda e: e["h"]), "").alias("html"), F.size(x).alias("parts"))

        return once(F.transform(F.sequence(start, end - 1), part), whole)

    return once(blocks, islands)


def page_blocks(boxes: Column, tables: Column) -> Column:
    """The blocks (kind, text, html) of a page's boxes (type, bbox, lines) in reading order, with the boxes of its tables."""
    placed = F.transform(boxes, lambda b: F.struct(b.alias("b"), F.when(b["type"] != 1, table_of(b["bbox"], tables)).alias("table")))

    def block(kind: str, text: Column, html: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), html.alias("html"))

    def text_of(b: Column) -> Column:
        lines = F.transform(b["lines"], lambda spans: once(styled(spans), lambda s: F.struct(s["plain"].alias("plain"), s["html"].alias("html"))))
        return once(joined(lines), lambda t: F.when((t["text"] != "") & ~t["text"].rlike(PAGE_NUMBER), block(PARAGRAPH, t["text"], t["html"])))

    def all_of(found: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            again = F.exists(F.slice(found, F.lit(1), i), lambda y: y["table"].eqNullSafe(x["table"]))  # a page has few boxes
            mark = F.when(x["b"]["type"] == 1, block(MARKER, F.lit(MARK_IMAGE), F.lit(""))).when(x["table"].isNotNull() & ~again, block(MARKER, F.lit(MARK_TABLE), F.lit("")))
            return F.when((x["b"]["type"] == 1) | x["table"].isNotNull(), mark).otherwise(text_of(x["b"]))

        return F.filter(F.transform(found, one), lambda b: b.isNotNull())

    return once(placed, all_of)


def laid_out(pages: Column) -> Column:
    """The merged blocks of a document's pages (boxes, tables)."""
    return merged(F.flatten(F.transform(pages, lambda p: page_blocks(p["boxes"], p["tables"]))))


def scanned(pages: Column) -> Column:
    """(n, first ten numbers, from 1) of the pages (page, boxes) that hold images and no text."""
    has_text = lambda b: (b["type"] != 1) & F.exists(b["lines"], lambda line: F.exists(line, lambda s: F.trim(s["text"]) != ""))
    found = F.transform(F.filter(pages, lambda p: F.exists(p["boxes"], lambda b: b["type"] == 1) & ~F.exists(p["boxes"], has_text)), lambda p: p["page"] + 1)
    return once(found, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.slice(x, 1, 10).alias("first")))


def join_lines(rows: DataFrame, key: list[str], order: str, plain: str = "plain", html: str = "html") -> DataFrame:
    """One row a key: its lines (rows with text) ``joined``."""
    real = rows.filter(F.trim(collapse(F.col(plain))) != "")
    got = real.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(plain).alias("plain"), F.col(html).alias("html")))).alias("x"))
    return got.select(*key, joined(F.col("x")).alias("x")).select(*key, "x.*")


def table_of(bbox: Column, tables: Column) -> Column:
    """0-based place of the first table that holds over half of a box's area, or null."""

    def share(t: Column) -> Column:
        w = F.least(bbox["x1"], t["x1"]) - F.greatest(bbox["x0"], t["x0"])
        h = F.least(bbox["y1"], t["y1"]) - F.greatest(bbox["y0"], t["y0"])
        return (w > 0) & (h > 0) & (w * h > 0.5 * (bbox["x1"] - bbox["x0"]) * (bbox["y1"] - bbox["y0"]))

    return F.get(F.filter(F.transform(tables, lambda t, i: F.when(share(t), i)), lambda i: i.isNotNull()), 0)


def merge_fragments(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The blocks (kind, text, html) of each key ``merged``, numbered as ``pos``."""
    got = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, "kind", "text", "html"))).alias("x"))
    return got.select(*key, F.posexplode(merged(F.col("x"))).alias("pos", "x")).select(*key, "pos", "x.*")


def pages_of(pdf_blocks: DataFrame, pdf_tables: DataFrame | None = None) -> DataFrame:
    """doc_id and its pages (page, boxes, tables), of layout rows (doc_id, page, pos, type, bbox, lines) and (doc_id, page, table_idx, bbox)."""
    placed = pdf_blocks.repartition("doc_id").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "bbox", "lines"))).alias("boxes"))
    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    if pdf_tables is None:
        placed = placed.withColumn("tables", none)
    else:
        tables = pdf_tables.repartition("doc_id").groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_idx", "bbox"))), lambda t: t["bbox"]).alias("tables"))
        placed = placed.join(tables, ["doc_id", "page"], "left").withColumn("tables", F.coalesce("tables", none))
    return placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "boxes", "tables"))).alias("pages"))


def layout_blocks(pdf_blocks: DataFrame, pdf_tables: DataFrame) -> DataFrame:
    """Numbered, merged blocks of documents given as layout rows and tables, as ``pages_of`` takes them."""
    return numbered(pages_of(pdf_blocks, pdf_tables))


def numbered(docs: DataFrame) -> DataFrame:
    """The blocks of documents (doc_id, pages), numbered, without a shuffle."""
    found = docs.select("doc_id", F.posexplode(laid_out(F.col("pages"))).alias("block_idx", "b"))
    return found.select("doc_id", F.lit(0).alias("chapter_idx"), "block_idx", "b.kind", "b.text", "b.html", F.lit(2).alias("level"))


def scanned_pages(pdf_blocks: DataFrame) -> DataFrame:
    """doc_id, n_scanned and the first ten page numbers (from 1) of pages with images and no text, of layout rows."""
    return scanned_documents(pages_of(pdf_blocks))


def scanned_documents(docs: DataFrame) -> DataFrame:
    """The same of documents (doc_id, pages)."""
    found = docs.select("doc_id", scanned(F.col("pages")).alias("s")).filter("s.n > 0")
    return found.select("doc_id", F.col("s.n").alias("n_scanned"), F.col("s.first").alias("first_pages"))
