"""TXT and Markdown: from text to blocks.

All of it is Column expressions. In a text without a sign of structure each stretch
between blank lines is one paragraph; in others each line gets a letter for what it
starts, and an automaton over the letters makes blocks of the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, WS_CHARS, image_count, marked, normal_lines, once, plain, without_images
from ..schema import HEADING, MARK_IMAGE, MARK_NOTE, MARK_TABLE, MARKER, PARAGRAPH
from .blocks import marks

# What lines look like, after the sign of a quote.
QUOTE = rf"\A[{WS}]{{0,3}}>[{WS}]?"
TITLE = rf"\A(#{{1,6}})[{WS}]"
RULE = rf"\A[{WS}]{{0,3}}(?:-{{3,}}+|\*{{3,}}+|_{{3,}}+)[{WS}]*+\z"
NOTE = rf"\A[{WS}]{{0,3}}\[\^[^\]]++\]:"
ITEM = rf"\A[{WS}]{{0,3}}(?:[-*+]|\p{{Nd}}{{1,3}}[.)])[{WS}]+"
#: A table's second line has these signs alone, a bar among them that isn't the first.
SEPARATOR, BAR_INSIDE = rf"\A[{WS}:|-]++\z", r"(?s)\A.[^|]*+\|"
#: A stretch that matches this may hold more than one paragraph.
STRUCTURED = rf"\||(?m)(?:^#|^[{WS}&&[^\n]]{{0,3}}(?:[-*+_>]|\p{{Nd}}{{1,3}}[.)]|\[\^))"
#: A line without any of these signs at its start, nor a bar, is text.
SIGNS = rf"\||\A#|\A[{WS}]{{0,3}}(?:[-*+_>\[]|\p{{Nd}})"

#: The automaton over a letter a line, capital where the line has a bar: a table takes the lines with bars that follow, an
#: item and a paragraph lines of text (an item also those that else start a note), a note all up to a blank line.
CONSTRUCTS = "T[A-Z]*|[Ii][XxNn]*|[Xx]+|[Nn][^b]*|[Hh]|[Rr]|q|b"


def _strip(text: Column) -> Column:
    return F.trim(text, F.lit(WS_CHARS))


def _letters(raw: Column, after: Column) -> Column:
    """(c, v, level) of a line, with the line after it: the letter of what it starts if no construct before takes it, and its text without signs."""
    line = F.when(raw.rlike(QUOTE), F.regexp_replace(raw, QUOTE, "")).otherwise(raw)
    table = F.contains(raw, F.lit("|")) & F.coalesce(F.contains(after, F.lit("|")) & after.rlike(SEPARATOR) & after.rlike(BAR_INSIDE), F.lit(False))

    def found(line: Column) -> Column:
        letter = (
            F.when(~line.rlike(rf"[^{WS}]"), "q").when(line.rlike(TITLE), "h").when(line.rlike(RULE), "r")
            .when(line.rlike(NOTE), "n").when(table, "t").when(line.rlike(ITEM), "i").otherwise("x")
        )
        return F.struct(line.alias("line"), letter.alias("c"))

    def valued(x: Column) -> Column:
        # a title ends before signs that close it, with the white space around them
        title = F.rtrim(F.rtrim(F.rtrim(F.regexp_replace(x["line"], r"\A#{1,6}", ""), F.lit(WS_CHARS)), F.lit("#")), F.lit(WS_CHARS))
        value = F.when(x["c"] == "h", F.ltrim(title, F.lit(WS_CHARS))).when(x["c"] == "i", _strip(F.regexp_replace(x["line"], ITEM, ""))).otherwise(_strip(x["line"]))
        level = F.when(x["c"] == "h", F.length(F.regexp_extract(x["line"], TITLE, 1))).otherwise(2)
        return F.struct(F.when(F.contains(raw, F.lit("|")), F.upper(x["c"])).otherwise(x["c"]).alias("c"), value.alias("v"), level.alias("level"))

    def plain(c: str, value: Column) -> Column:
        return F.struct(F.lit(c).alias("c"), value.alias("v"), F.lit(2).alias("level"))

    # a value that is used more than once goes through an array of one
    signed = F.transform(F.transform(F.array(line), found), valued)[0]
    return F.when(raw.rlike(SIGNS), signed).when(raw.rlike(rf"[^{WS}]"), plain("x", _strip(raw))).otherwise(plain("b", F.lit("")))


def pieces(text: Column) -> Column:
    """The blocks of a text, with inline markup; null where the text is.

    A line's letter depends on it and the next line alone. The letters of a text are
    one string, and the automaton that says which lines belong together is a regular
    expression over it, so a text takes linear time and never leaves the JVM.
    """

    def starts(lines: Column) -> Column:
        parts = F.regexp_extract_all(F.array_join(F.transform(lines, lambda x: x["c"]), ""), F.lit(CONSTRUCTS), F.lit(0))
        # each letter that begins a construct, and a dot for each other
        firsts = F.split(F.array_join(F.transform(parts, lambda p: F.concat(F.left(p, F.lit(1)), F.repeat(F.lit("."), F.length(p) - 1))), ""), "")
        return F.filter(F.transform(firsts, lambda c, i: F.when((c != ".") & (c != ""), i)), lambda i: i.isNotNull())

    def piece(lines: Column, start: Column, end: Column) -> Column:
        first = F.get(lines, start)
        text = F.array_join(F.transform(F.slice(lines, start + 1, end - start), lambda x: x["v"]), " ")
        c = F.lower(first["c"])
        kind = F.when(c == "h", HEADING).when(c.isin("n", "t"), MARKER).when(c.isin("i", "x"), PARAGRAPH)
        md = F.when(c == "h", first["v"]).when(c == "n", MARK_NOTE).when(c == "t", MARK_TABLE).otherwise(text)
        return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), md.alias("md"), first["level"].alias("level")))

    def cut(lines: Column) -> Column:
        found = once(starts(lines), lambda at: F.transform(at, lambda start, i: piece(lines, start, F.coalesce(F.get(at, i + 1), F.size(lines)))))
        return F.filter(found, lambda p: p.isNotNull())

    letters = once(F.split(text, "\n"), lambda raw: F.transform(raw, lambda x, i: _letters(x, F.get(raw, i + 1))))
    return F.when(text.isNotNull(), once(letters, cut))


def stretches(text: Column) -> Column:
    """The parts of a text between blank lines; blank ones are left out."""
    cut = F.split(text, rf"\n(?:[{WS}]*\n)+")
    return F.filter(cut, lambda x: x.rlike(rf"[^{WS}]"))


def plain_piece(stretch: Column) -> Column:
    """A stretch without structure: one paragraph."""
    joined = F.regexp_replace(F.regexp_replace(stretch, rf"\A[{WS}]*\n|\n[{WS}]*\z", ""), rf"[{WS}]*\n[{WS}]*", " ")
    return F.array(F.struct(F.lit(PARAGRAPH).alias("kind"), joined.alias("md"), F.lit(2).alias("level")))


def of_piece(p: Column, html: bool = True) -> Column:
    """The blocks of a piece: its images' markers, then itself with its inline markup done (no HTML, if none is wanted)."""
    paragraph = p["kind"] == PARAGRAPH
    images = F.when(paragraph & F.contains(p["md"], F.lit("![")), image_count(p["md"])).otherwise(0)
    body = F.when(images > 0, without_images(p["md"])).otherwise(p["md"])
    is_marker = p["kind"] == MARKER
    own = F.struct(p["kind"].alias("kind"), F.when(is_marker, p["md"]).otherwise(plain(body)).alias("text"), (F.when(is_marker, "").otherwise(marked(body)) if html else F.lit("")).alias("html"), p["level"].cast("int").alias("level"))
    return F.concat(marks(images, MARK_IMAGE), F.array(own))


def block_array(text: Column, html: bool = True) -> Column:
    """The blocks of a text as an array in its row: kind, text, html, level. Without ``html`` that field is empty, and its work isn't done."""

    def of_normal(normal: Column) -> Column:
        found = F.when(normal.rlike(STRUCTURED), pieces(normal)).otherwise(F.flatten(F.transform(stretches(normal), plain_piece)))
        return F.filter(F.flatten(F.transform(found, lambda p: of_piece(p, html))), lambda b: b["text"] != "")

    return once(normal_lines(F.coalesce(text, F.lit(""))), of_normal)


def text_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", html: bool = True) -> DataFrame:
    """Numbered blocks of documents given as text: doc_id, chapter_idx, block_idx, kind, text, html, level.

    A document's blocks stay in its row, so they are numbered without a shuffle.
    Without ``html`` that column is empty, and its work isn't done.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(block_array(F.col(text_col), html)).alias("block_idx", "b"))
    return found.select("doc_id", F.lit(0).alias("chapter_idx"), "block_idx", "b.*")
