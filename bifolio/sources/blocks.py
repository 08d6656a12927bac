"""Blocks as struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MARKER

BLOCK = "struct<kind:string,text:string,html:string,level:int>"


def block(kind: Column, text: Column, html: Column, level: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"), html.alias("html"), level.cast("int").alias("level"))


def marks(n: Column, text: str) -> Column:
    """An array of n markers."""
    return F.array_repeat(block(F.lit(MARKER), F.lit(text), F.lit(""), F.lit(2)), n)


def without_empty(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["text"] != "")
