"""PDF: needs a layout library, which may not be installed.

The library's part is small: pages, their layout blocks in reading order, and
the boxes of tables. They come out as the arrays that ``operators.layout`` makes
blocks of.
"""

from __future__ import annotations

from .errors import ReadError

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
LAYOUT = f"array<struct<page:int,boxes:array<struct<pos:int,type:int,bbox:{BOX},lines:array<array<struct<text:string,flags:int>>>>>,tables:array<{BOX}>>>"


def _box(corners) -> dict:
    return dict(zip(("x0", "y0", "x1", "y1"), map(float, corners), strict=True))


def as_rows(pages: list[dict]) -> list[dict]:
    """The pages of a layout, each given as its ``blocks`` (type, bbox, lines of spans) and ``tables`` (boxes), as LAYOUT has them."""

    def box(pos: int, b: dict) -> dict:
        lines = [[{"text": s.get("text", ""), "flags": s.get("flags", 0)} for s in line.get("spans", [])] for line in b.get("lines", [])]
        return {"pos": pos, "type": b.get("type", 0), "bbox": _box(b.get("bbox", (0, 0, 0, 0))), "lines": lines}

    return [{"page": p, "boxes": [box(i, b) for i, b in enumerate(page["blocks"])], "tables": [_box(t) for t in page["tables"]]} for p, page in enumerate(pages)]


def layout(name: str, content: bytes) -> list[dict]:
    """A file's layout rows."""
    try:
        import pymupdf
    except ImportError:
        raise ReadError(f"«{name}»: no hay ninguna biblioteca para leer PDF en este entorno.") from None
    try:
        book = pymupdf.open(stream=content, filetype="pdf")
    except Exception as e:  # the library raises many kinds
        raise ReadError(f"«{name}» no se puede abrir como PDF: {e}") from None
    if book.needs_pass:
        raise ReadError(f"«{name}» está cifrado con contraseña; no soportado.")
    pages = []
    for page in book:
        try:
            tables = [t.bbox for t in page.find_tables().tables]
        except Exception:
            tables = []
        pages.append({"blocks": page.get_text("dict", sort=True).get("blocks", []), "tables": tables})
    return as_rows(pages)
