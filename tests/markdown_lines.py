"""The Markdown rules as a plain loop over lines, to compare with."""

import re

from bifolio.schema import HEADING, MARK_NOTE, MARK_TABLE, MARKER, PARAGRAPH

QUOTE = re.compile(r"^\s{0,3}>\s?")
TITLE = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
RULE = re.compile(r"^\s{0,3}(?:-{3,}|\*{3,}|_{3,})\s*$")
NOTE = re.compile(r"^\s{0,3}\[\^[^\]]+\]:")
SEPARATOR = re.compile(r"^\s*\|?[\s:|-]+\|[\s:|-]*\|?\s*$")
ITEM = re.compile(r"^\s{0,3}(?:[-*+]|\d{1,3}[.)])\s+(.*)$")

def line_kinds(lines: list[str]) -> list[tuple[str, object]]:
    """What each line starts, if no construct before it takes it."""
    found: list[tuple[str, object]] = []
    for i, raw in enumerate(lines):
        line = QUOTE.sub("", raw)
        if not line.strip():
            found.append(("blank", None))
        elif m := TITLE.match(line):
            found.append(("title", (len(m[1]), m[2])))
        elif RULE.match(line):
            found.append(("rule", None))
        elif NOTE.match(line):
            found.append(("note", line.strip()))
        elif "|" in raw and i + 1 < len(lines) and "|" in lines[i + 1] and SEPARATOR.match(lines[i + 1]):
            found.append(("table", line.strip()))
        elif m := ITEM.match(line):
            found.append(("item", m[1].strip()))
        else:
            found.append(("text", line.strip()))
    return found


def pieces(stretch: str) -> list[dict]:
    """The blocks of a stretch without blank lines, with inline markup."""
    lines = stretch.split("\n")
    kinds = line_kinds(lines)
    out: list[dict] = []
    open_text: list[str] | None = None  # the lines of a paragraph or an item
    in_item = False
    skip = ""  # "note": all that follows; "table": while lines have a bar

    def close() -> None:
        nonlocal open_text, in_item
        if open_text is not None:
            out.append({"kind": PARAGRAPH, "md": " ".join(open_text), "level": 2})
        open_text, in_item = None, False

    for raw, (kind, value) in zip(lines, kinds, strict=True):
        if skip == "note" or (skip == "table" and "|" in raw):
            continue
        skip = ""
        if in_item and kind == "note":  # an item takes the start of a note as text, unless that starts an item too
            kind = "text"
        if kind == "text":
            open_text = [*(open_text or []), value]
            continue
        close()
        if kind == "title":
            out.append({"kind": HEADING, "md": value[1], "level": value[0]})
        elif kind in ("note", "table"):
            out.append({"kind": MARKER, "md": MARK_NOTE if kind == "note" else MARK_TABLE, "level": 2})
            skip = kind
        elif kind == "item":
            open_text, in_item = [value], True
    close()
    return out
