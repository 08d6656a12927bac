r"""Text functions as Column expressions.

White space is Python's set, spelled out, as Java's ``\s`` is a smaller one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that Python calls white space, as the inside of a character class. Java tries the parts of a
# class one by one for each character; most characters fail the range before the &&, so they are let go after two trials.
WS = r"[\x00-\x20\x85-\u3000&&[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
#: The same as a string.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: cp1252 for the bytes 80 to 9F: what each becomes; U+FFFD for the five it leaves open.
CP1252 = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))
LATIN1 = "".join(chr(b) for b in range(0x80, 0xA0))

# Inline markup of Markdown.
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
LINK = r"\[([^\]]+)\]\(([^)]*)\)"
CODE = r"`([^`]*)`"
NOTE_REFERENCE = r"\[\^[^\]]+\]"
BOLD = r"\*\*(.+?)\*\*|__(.+?)__"
ITALIC = r"(?<!\*)\*([^*\n]+)\*(?!\*)|(?<!_)_([^_\n]+)_(?!_)"


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of x, which is computed once however often it is used: within a lambda a column would be computed for each element."""
    return F.transform(F.array(x), use)[0]


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def word_count(text: Column) -> Column:
    """Number of stretches without white space."""
    return F.regexp_count(text, F.lit(f"[^{WS}]+")).cast("long")


def escape(text: Column, quotes: bool = False) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


# Flags of formatting.
ITALIC_FLAG, BOLD_FLAG = 2, 16


def styled(spans: Column) -> Column:
    """(plain, html) of an array of (text, flags)."""

    def html(s: Column) -> Column:
        inner = escape(s["text"])
        for flag, tag in ((ITALIC_FLAG, "i"), (BOLD_FLAG, "b")):
            inner = F.when(s["flags"].bitwiseAND(flag) != 0, F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))).otherwise(inner)
        return inner

    real = F.filter(spans, lambda s: s["text"] != "")
    return F.struct(F.array_join(F.transform(real, lambda s: s["text"]), "").alias("plain"), F.array_join(F.transform(real, html), "").alias("html"))


def image_count(md: Column) -> Column:
    return F.size(F.regexp_extract_all(md, F.lit(IMAGE), F.lit(0)))


def without_images(md: Column) -> Column:
    return F.regexp_replace(md, IMAGE, "")


def _unlinked(md: Column) -> Column:
    for pattern, by in ((NOTE_REFERENCE, ""), (LINK, "$1"), (CODE, "$1")):
        md = F.regexp_replace(md, pattern, by)
    return collapse(md)


#: Text without any of these has no inline markup.
MARKUP = r"[*_`\[]"


def plain(md: Column) -> Column:
    """Inline Markdown as plain text: references go, links and code keep their text, then bold, then italics."""
    inside = F.regexp_replace(F.regexp_replace(_unlinked(md), BOLD, "$1$2"), ITALIC, "$1$2")
    return F.when(md.rlike(MARKUP), inside).otherwise(collapse(md))


def marked(md: Column) -> Column:
    """Inline Markdown as safe HTML with b and i."""
    inside = F.regexp_replace(F.regexp_replace(escape(_unlinked(md)), BOLD, "<b>$1$2</b>"), ITALIC, "<i>$1$2</i>")
    return F.when(md.rlike(MARKUP), inside).otherwise(escape(collapse(md)))


def decoded(content: Column) -> Column:
    """A file's text: UTF-8 without a byte order mark, or else cp1252."""
    utf8 = content.cast("string")
    single = F.translate(F.decode(content, "ISO-8859-1"), LATIN1, CP1252)
    return F.when(F.is_valid_utf8(utf8), F.regexp_replace(utf8, r"\A\ufeff", "")).otherwise(single)


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def normal_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def stem(path: Column) -> Column:
    """The last part of a path, without its last suffix."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def thousands(n: Column) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit("."))


def duration(seconds: Column) -> Column:
    s = F.rint(seconds).cast("long")
    m, h = F.floor(s / 60), F.floor(s / 3600)
    return F.when(s < 60, F.format_string("%d s", s)).when(m < 60, F.format_string("%d min %d s", m, s % 60)).otherwise(F.format_string("%d h %d min", h, m % 60))


def rate_and_eta(done: Column, total: Column, seconds: Column) -> Column:
    """Blocks a second and the seconds left; null while nothing is done."""
    rate = F.when((done > 0) & (seconds > 0), done / seconds)
    return F.struct(rate.alias("rate"), ((total - done) / rate).alias("eta"))


def job_key(sha256: Column, source: Column, target: Column) -> Column:
    return F.concat_ws("-", F.substring(sha256, 1, 12), source, target)


def chapter_file(chapter: Column) -> Column:
    return F.format_string("cap-%03d.jsonl", chapter)
