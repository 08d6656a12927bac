"""Kinds of block, marker texts and table schemas."""

PARAGRAPH, HEADING, MARKER = "paragraph", "heading", "marker"
TRANSLATABLE = (PARAGRAPH, HEADING)

# The texts that stand for what is left out.
MARK_IMAGE, MARK_TABLE, MARK_NOTE = "[imagen omitida]", "[tabla omitida]", "[nota omitida]"
MARKERS = (MARK_IMAGE, MARK_TABLE, MARK_NOTE)

PIVOT = "en"
SAMPLE_CHARS = 4000

BLOCKS = "doc_id string, chapter_idx int, block_idx int, kind string, text string, html string, level int"
TRANSLATIONS = "sha256 string, pair string, chapter_idx int, block_idx int, t string, seq bigint"
PACKAGES = "from_code string, from_name string, to_code string, to_name string, installed boolean, ord int"
