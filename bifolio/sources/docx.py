"""DOCX: a Word document's body as rows, and the blocks that follow from them.

Python only takes the XML apart: a row for each paragraph and table of the body,
with its style, its runs of text and their formatting, and how many images and
notes it holds. Levels of headings, inline HTML and markers are Column expressions
on these rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import collapse, styled
from ..schema import HEADING, MARK_IMAGE, MARK_NOTE, MARK_TABLE, PARAGRAPH
from .blocks import block, marks, without_empty
from .errors import ReadError

NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Names of heading styles, the values that turn formatting off, and the flags of formatting.
HEADING_STYLE = r"(?i)^(?:heading|t[íi]tulo)\s*([0-9])?"
TITLE_STYLE = "Title"
OFF = ("0", "false", "off", "none")
FLAGS = {"i": 2, "b": 16}
# What stands for text in a run, beside its text.
SIGNS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
#: Elements of which each in a paragraph is an omission.
IMAGE_TAGS, NOTE_TAGS = ("drawing", "pict"), ("footnoteReference", "endnoteReference")

BODY = "array<struct<is_table:boolean,style:string,style_id:string,images:int,notes:int,runs:array<struct<text:string,flags:int>>>>"


def styles(archive: zipfile.ZipFile) -> tuple[dict[str, str], str]:
    """(names of styles by id, id of the paragraphs' default style)."""
    names, default = {}, ""
    if "word/styles.xml" in archive.namelist():
        for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{NS}style"):
            own, name = style.get(f"{NS}styleId", ""), style.find(f"{NS}name")
            names[own] = name.get(f"{NS}val", "") if name is not None else ""
            if style.get(f"{NS}type") == "paragraph" and style.get(f"{NS}default") in ("1", "true"):
                default = default or own
    return names, default


def spans(paragraph: ElementTree.Element) -> list[dict]:
    """The text runs of a paragraph, those of its links among them, with their formatting as flags."""
    found = []
    for run in paragraph.iterfind("*"):
        for r in run.iterfind(f"{NS}r") if run.tag == f"{NS}hyperlink" else [run] if run.tag == f"{NS}r" else []:
            on = {f.tag.removeprefix(NS) for f in r.iterfind(f"{NS}rPr/*") if f.get(f"{NS}val", "1").lower() not in OFF}
            text = "".join(x.text or "" if x.tag == f"{NS}t" else SIGNS.get(x.tag.removeprefix(NS), "") for x in r)
            found.append({"text": text, "flags": sum(flag for name, flag in FLAGS.items() if name in on)})
    return found


def body(name: str, content: bytes) -> list[dict]:
    """The rows of a document's body, in order."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names, default = styles(archive)
            top = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{NS}body")
    except Exception as e:  # damage shows in many ways
        raise ReadError(f"«{name}» no se puede abrir como DOCX: {e}") from None
    if top is None:
        raise ReadError(f"«{name}» no se puede abrir como DOCX: body")
    rows = []
    for item in top.iterfind("*"):
        if item.tag in (f"{NS}tbl", f"{NS}p"):
            own = next((s.get(f"{NS}val", "") for s in item.iterfind(f"{NS}pPr/{NS}pStyle")), default)
            tags = [x.tag.removeprefix(NS) for x in item.iter()] if item.tag == f"{NS}p" else []
            count = {kind: sum(t in some for t in tags) for kind, some in (("images", IMAGE_TAGS), ("notes", NOTE_TAGS))}
            rows.append({"is_table": not tags, "style": names.get(own, ""), "style_id": own, **count, "runs": spans(item) if tags else []})
    return rows


def heading_level(name: Column) -> Column:
    """The level that a style's name gives, or null."""
    name = F.regexp_replace(name, re.escape(TITLE_STYLE), "Heading 1")
    digit = F.regexp_extract(name, HEADING_STYLE, 1)
    return F.when(name.rlike(HEADING_STYLE), F.least(F.when(digit == "", 1).otherwise(digit.cast("int")), F.lit(6)))


def blocks(rows: Column) -> Column:
    """The blocks of a body's rows, markers before their paragraph."""

    def of_row(r: Column) -> Column:
        text = styled(r["runs"])
        level = F.coalesce(heading_level(r["style"]), heading_level(r["style_id"]))
        own = block(F.when(level.isNull(), PARAGRAPH).otherwise(HEADING), collapse(text["plain"]), collapse(text["html"]), F.coalesce(level, F.lit(2)))
        return F.when(r["is_table"], marks(F.lit(1), MARK_TABLE)).otherwise(F.concat(marks(r["images"], MARK_IMAGE), marks(r["notes"], MARK_NOTE), F.array(own)))

    return without_empty(F.flatten(F.transform(rows, of_row)))
