"""Readers and rules on small inputs, a case for each rule."""

import html
import io
import random
import re
import time
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bifolio.functions import text as T
from bifolio.schema import MARK_IMAGE, MARK_NOTE, MARK_TABLE
from bifolio.sources import files, html_walk, textmd

from . import markdown_lines

TXT = "# One Title\n\nFirst paragraph of text,\nwrapped hard.\n\nSecond one.\n\n## Two\n\n" + "\n\n".join(f"Paragraph number {i} here." for i in range(3, 9)) + "\n\n### Three\n"


def kinds(spark, md):
    rows = textmd.text_blocks(spark.createDataFrame([(1, md)], "doc_id long, text string")).orderBy("block_idx").collect()
    assert [r["block_idx"] for r in rows] == list(range(len(rows)))
    return [(r["kind"], r["text"]) for r in rows]


P, H, M = "paragraph", "heading", "marker"


@pytest.mark.parametrize(
    ("md", "want"),
    [
        ("a\nb\n\n \t\nc", [(P, "a b"), (P, "c")]),
        ("\n \n\ta\n\n", [(P, "a")]),
        ("## Head ##\ntext", [(H, "Head"), (P, "text")]),
        ("Title\n=====\nmore\n---\nrest", [(P, "Title ===== more"), (P, "rest")]),
        ("> # Quoted\n> text", [(H, "Quoted"), (P, "text")]),
        ("| a | b |\n|---|---|\n| 1 | 2 |\nafter", [(M, MARK_TABLE), (P, "after")]),
        ("> | a | b |\n> |---|---|", [(P, "| a | b | |---|---|")]),
        ("| a | b |\nno table", [(P, "| a | b | no table")]),
        ("text\n[^1]: a note\nmore of it\n- and this\n\nafter", [(P, "text"), (M, MARK_NOTE), (P, "after")]),
        ("- one\n  two\n- three\n# H", [(P, "one two"), (P, "three"), (H, "H")]),
        ("1. one\n[^n]: stays\n\nx", [(P, "one : stays"), (P, "x")]),
        ("    - far", [(P, "- far")]),
        ("```\ncode\n```", [(P, "code")]),
        ("see ![a](b) and ![c](d) [link](u) `x` **bo *it* ld** _i_ [^1]", [(M, MARK_IMAGE), (M, MARK_IMAGE), (P, "see and link x bo it ld i")]),
        ("# ![alt](u)", [(H, "!alt")]),
        ("![a](b)", [(M, MARK_IMAGE)]),
        ("** **", [(P, " ")]),
        ("__a__ *b*", [(P, "a b")]),
        ("a\x1cb c　d e", [(P, "a b c d e")]),
        ("", []),
    ],
)
def test_markdown_rules(spark, md, want):
    assert kinds(spark, md) == want


def test_inline_html(spark):
    row = spark.createDataFrame([("a <b> & **x *y* z** _w_",)], "t string").select(T.marked(F.col("t")).alias("h")).head()
    assert row["h"] == "a &lt;b&gt; &amp; <b>x <i>y</i> z</b> <i>w</i>"


def test_white_space_is_pythons(spark):
    points = [chr(c) for c in range(1, 0x3100)]
    rows = spark.createDataFrame([(c,) for c in points], "c string").filter(F.col("c").rlike(f"^[{T.WS}]$")).collect()
    assert {r["c"] for r in rows} == {c for c in points if c.isspace()}


def test_escape_and_cp1252(spark):
    row = spark.createDataFrame([("<a href=\"x\">'&",)], "t string").select(T.escape(F.col("t")).alias("a"), T.escape(F.col("t"), quotes=True).alias("b")).head()
    assert row["a"] == html.escape("<a href=\"x\">'&", quote=False) and row["b"] == html.escape("<a href=\"x\">'&")
    data = bytes(range(0x20, 0x100))
    rows = spark.createDataFrame([(bytearray(data),), (bytearray(b"\xef\xbb\xbfh\xc3\xa9"),)], "c binary").select(T.decoded(F.col("c")).alias("t")).collect()
    assert rows[0]["t"] == data.decode("cp1252", "replace") and rows[1]["t"] == "hé"


def test_fast_way_equals_slow_way(spark):
    r = random.Random(7)
    lines = ["", " ", "text", "more text", "# h", "- item", "  cont", "| a | b |", "|--|--|", "---", "> q", "[^1]: n", "3) x", "*em* and", "__b__", "![i](u) x", "\t"]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(12)))) for i in range(300)]
    got = {}
    for row in textmd.text_blocks(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id", "block_idx").collect():
        got.setdefault(row["doc_id"], []).append((row["kind"], row["text"]))
    for i, t in docs:  # the whole text, not cut at blank lines, through the slow way
        want = []
        for stretch in re.split(r"\n(?:\s*\n)*(?=\n|\Z)|(?:\A|\n)\s*\n", t):
            want += [p for p in markdown_lines.pieces(stretch) if p["md"].strip()] if stretch.strip() else []
        images = sum(len(re.findall(T.IMAGE, p["md"])) for p in want if p["kind"] == P)
        assert sum(k == M and x == MARK_IMAGE for k, x in got.get(i, [])) == images
        assert [k for k, x in got.get(i, []) if x != MARK_IMAGE] == [p["kind"] for p in want if re.sub(T.IMAGE, "", p["md"]).strip()]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body>bare<p>a<p>b <b>c</b></body>", [(P, "a", "a"), (P, "b c", "b <b>c</b>")]),
        ("<div>only text <i>x</i></div>", [(P, "only text x", "only text <i>x</i>")]),
        ("<div>lost<h2>Head</h2></div>", [(H, "Head", "Head")]),
        ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", [(P, "a", "a"), (P, "b", "b"), (P, "c", "c")]),
        ("<p>x<svg><image/></svg><img>y</p>", [(M, MARK_IMAGE, ""), (M, MARK_IMAGE, ""), (M, MARK_IMAGE, ""), (P, "xy", "xy")]),
        ('<section epub:type="footnotes"><p>n</p><p>m</p></section><p>t</p>', [(M, MARK_NOTE, ""), (P, "t", "t")]),
        ('<p>t<sup><a href="#n">1</a></sup><a epub:type="noteref">2</a><sup>3</sup></p>', [(P, "t3", "t3")]),
        ("<table><tr><td>x</table><hr><script>s</script><p>a<br>b</p>", [(M, MARK_TABLE, ""), (P, "a b", "a b")]),
        ("<p>a<!--c-->b</p>", [(P, "acb", "acb")]),
        ("<p>&lt;&amp;</p>", [(P, "<&", "&lt;&amp;")]),
        ("<dl><dt>t<dd>d</dl>", [(P, "td", "td")]),
        ("<dl><dt>t<dd><p>d</dl>", [(P, "t", "t"), (P, "d", "d")]),
        ("", []),
    ],
)
def test_html_rules(page, want):
    assert [(b["kind"], b["text"], b["html"]) for b in html_walk.blocks(page)] == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<h1>a &amp;&amp</h1>", "a &&amp"),
        ("<p>&amp x &ampy; &notit; &am</p>", "&amp x &ampy; &notit; &am"),
        ("<p>a<!--&amp;&amp-->&#65;&#x42;&lt;b&eacute;&", "a&amp;&ampAB<bé&"),
    ],
)
def test_entities_need_their_semicolon(page, want):
    assert [b["text"] for b in html_walk.blocks(page)] == [want]


def test_pages_leave_python_by_stretches():
    """However many pages a batch has, the blocks of some of them are held at once."""
    page = "<p>" + "x" * 5000 + "</p><p>&amp;</p>"
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "html": [None, "", *[page] * 998]})
    out = list(html_walk.block_rows([batch]))
    assert len(out) > 3
    assert max(b.nbytes for b in out) < 4 << 20
    rows = [r for b in out for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert [(r[0], r[1], r[2], len(r[3]), r[5]) for r in rows] == [x for i in range(2, 1000) for x in ((i, 0, P, 5000, 2), (i, 1, P, 1, 2))]


def test_white_space_is_told_apart_fast(spark):
    """Most characters aren't tried against each part of the class."""
    texts = spark.range(8, numPartitions=4).select(F.repeat(F.lit("some words, áé and more of them "), 30_000).alias("t")).cache()
    texts.count()
    spelled = "[^" + re.search(r"&&\[(.*)\]\]", T.WS)[1] + "]+"

    def took(count):
        began = time.perf_counter()
        found = texts.agg(F.sum(count)).head()[0]
        return time.perf_counter() - began, found

    slow, fast = (min(took(c) for _ in range(2)) for c in (F.regexp_count("t", F.lit(spelled)), T.word_count(F.col("t"))))
    assert fast[1] == slow[1] == 8 * 30_000 * 7
    assert fast[0] < slow[0] / 2


def epub(members, opf):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf">{opf}</package>')
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def word(body):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {ns}><w:style w:type="paragraph" w:styleId="T1"><w:name w:val="Title"/></w:style><w:style w:type="paragraph" w:styleId="Ttulo9"><w:name w:val="título 9"/></w:style></w:styles>')
    return out.getvalue()


def test_deep_and_long_pages():
    import time

    deep = "<p>a" + "<b>" * 3000 + "x" + "</b>" * 3000 + "<sup>" + "<i>" * 3000 + "<a>1</a>"
    assert html_walk.blocks(deep)[0]["text"] == "ax"
    began = time.time()
    assert len(html_walk.blocks("<div>" * 2000 + "<p>x</p>" * 20_000)) == 20_000
    assert time.time() - began < 5


def test_damaged_files_are_rows(spark, tmp_path):
    good = epub({"O/b.xhtml": "<body><p>c" + "d" * 500 + "</p></body>"}, '<manifest><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/></spine>')
    at = good.index(b"cddd")
    doc = word("<w:p><w:r><w:t>text</w:t></w:r></w:p>")
    locked = bytearray(good)
    for sign in (b"PK\x03\x04", b"PK\x01\x02"):  # the flag of an encrypted member
        i = -1
        while (i := locked.find(sign, i + 1)) >= 0:
            if b"b.xhtml" in locked[i : i + 60]:
                locked[i + (6 if sign[2] == 3 else 8)] |= 1
    inputs = {"crc.epub": good[:at] + b"X" + good[at + 1 :], "locked.epub": bytes(locked), "cut.epub": good[:200], "cut.docx": doc[: len(doc) // 2], "empty.docx": word(""), "empty.epub": epub({"O/b.xhtml": "<body> </body>"}, '<manifest><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/></spine>'), "good.epub": good, "good.docx": doc, "nothing.pdf": b""}
    for k, v in inputs.items():
        (tmp_path / k).write_bytes(v)
    documents, chapters, blocks = files.read(files.scan(spark, f"file://{tmp_path}"))
    errors = {r["doc_id"].rsplit("/", 1)[-1]: r["error"] for r in documents.collect()}
    assert set(errors) == set(inputs) and {k for k, e in errors.items() if e is None} == {"good.epub", "good.docx"}
    assert "CRC" in errors["crc.epub"] and "encrypted" in errors["locked.epub"] and errors["empty.docx"].endswith("no contiene texto.") and "no se ha encontrado texto" in errors["empty.epub"]
    assert {r["doc_id"].rsplit("/", 1)[-1] for r in blocks.collect()} == {r["doc_id"].rsplit("/", 1)[-1] for r in chapters.collect()} == {"good.epub", "good.docx"}


def test_pages_with_a_layout(spark):
    """What a layout library finds, through the tables of documents."""
    from bifolio.sources import pdf

    line = lambda *spans: {"spans": [{"text": t, "flags": f} for t, f in spans]}
    book = [{"blocks": [{"bbox": (0, 0, 9, 9), "lines": [line(("One ", 2), ("two-", 2)), line(("three", 0))]}, {"type": 1, "bbox": (0, 0, 1, 1)}], "tables": []}, {"blocks": [{"type": 1}], "tables": []}]
    scan = [{"blocks": [{"type": 1}], "tables": []}] * 11
    rows = [(k, k, "s", "PDF", k, [], None, None, None, None, pdf.as_rows(v)) for k, v in (("a.pdf", book), ("b.pdf", scan))]
    schema = f"doc_id string, path string, sha256 string, format string, title string, warnings array<string>, error string, text string, chapters array<struct<title:string,blocks:array<{files.BLOCK}>>>, body {files.docx.BODY}, pages {pdf.LAYOUT}"
    documents, chapters, blocks = files.tables(spark.createDataFrame(rows, schema))
    assert [(r["doc_id"], r["kind"], r["text"], r["html"]) for r in blocks.orderBy("block_idx").collect()] == [("a.pdf", P, "One twothree", "<i>One </i><i>two</i>three"), ("a.pdf", M, MARK_IMAGE, ""), ("a.pdf", M, MARK_IMAGE, "")]
    found = {r["doc_id"]: r for r in documents.collect()}
    assert found["a.pdf"]["error"] is None and found["a.pdf"]["warnings"] == ["PDF: 1 página(s) sin capa de texto omitida(s) (¿escaneadas?): 2. OCR fuera del alcance."]
    assert "parece escaneado" in found["b.pdf"]["error"] and "1, 2, 3, 4, 5, 6, 7, 8, 9, 10…" in found["b.pdf"]["warnings"][0]
    assert [r["doc_id"] for r in chapters.collect()] == ["a.pdf"]


def test_files(spark, tmp_path):
    opf = '<manifest><item id="a" href="no.xhtml"/><item id="a" href="c%201.xhtml"/><item id="b" href="b.xhtml"/><item id="m" href="gone.xhtml"/><item id="n" href="nav.xhtml"/><item id="e" href="e.xhtml"/></manifest><spine><itemref idref="n" linear="NO"/><itemref idref="e"/><itemref idref="a"/><itemref idref="x"/><itemref idref="m"/><itemref idref="b"/></spine>'
    book = epub({"O/c 1.xhtml": "<html><body><h1>One</h1><p>a <i>b</i></p></body></html>", "O/b.xhtml": "<body><p>c</p></body>", "O/nav.xhtml": "<p>nav</p>", "O/e.xhtml": "<body> </body>"}, opf)
    run = '<w:r><w:rPr><w:b/><w:i w:val="0"/></w:rPr><w:t>x</w:t></w:r><w:hyperlink><w:r><w:t> link</w:t></w:r></w:hyperlink>'
    doc = word(f'<w:p><w:pPr><w:pStyle w:val="T1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p>{run}<w:r><w:footnoteReference/></w:r><w:r><w:drawing/></w:r></w:p><w:tbl/><w:p><w:pPr><w:pStyle w:val="Ttulo9"/></w:pPr><w:r><w:t>Low</w:t></w:r></w:p><w:p/>')
    inputs = {"a.txt": TXT.encode(), "b.MD": b"caf\xe9", "e.txt": b"", "c.epub": book, "d.docx": doc, "bad.epub": b"no zip", "bad.docx": b"x", "x.rtf": b"?", "p.pdf": b"%PDF"}
    for k, v in inputs.items():
        (tmp_path / k).write_bytes(v)
    documents, chapters, blocks = files.read(files.scan(spark, f"file://{tmp_path}"))
    name = F.regexp_extract("doc_id", r"([^/]*)$", 1)
    docs = {r["name"]: r for r in documents.withColumn("name", name).collect()}
    assert set(docs) == set(inputs) and {k for k in docs if docs[k]["error"]} == {"bad.epub", "bad.docx", "x.rtf", "p.pdf"}
    assert docs["b.MD"]["warnings"] == [files.NOT_UTF8] and len(docs["c.epub"]["warnings"]) == 1 and docs["a.txt"]["format"] == "TXT"
    titles = {(r["name"], r["chapter_idx"]): r["title"] for r in chapters.withColumn("name", name).collect()}
    assert titles == {("a.txt", 0): "a", ("b.MD", 0): "b", ("e.txt", 0): "e", ("c.epub", 0): "One", ("c.epub", 1): "b", ("d.docx", 0): "d"}
    got = {}
    for r in blocks.withColumn("name", name).orderBy("name", "chapter_idx", "block_idx").collect():
        got.setdefault(r["name"], []).append((r["chapter_idx"], r["block_idx"], r["kind"], r["text"], r["html"], r["level"]))
    assert [x[2] for x in got["a.txt"]].count(P) == 8 and [x[2] for x in got["a.txt"]].count(H) == 3
    assert got["b.MD"][0][3] == "café" and "e.txt" not in got
    assert got["c.epub"] == [(0, 0, H, "One", "One", 1), (0, 1, P, "a b", "a <i>b</i>", 2), (1, 0, P, "c", "c", 2)]
    assert [(x[2], x[3], x[4], x[5]) for x in got["d.docx"]] == [(H, "Top", "Top", 1), (M, MARK_IMAGE, "", 2), (M, MARK_NOTE, "", 2), (P, "x link", "<b>x</b> link", 2), (M, MARK_TABLE, "", 2), (H, "Low", "Low", 6)]


def test_markdown_automaton_equals_the_loop(spark):
    """Random lines of all kinds, long runs and odd white space among them, against the plain loop: kinds, texts and levels."""
    r = random.Random(8)
    lines = [
        "", " ", "\t", "text", "  more  text ", "# h", "###### six ## #", "####### seven", "#no", "# ", "## ##", "# a#b # ", "- item", "-", "-\t", "  cont", "    - far", "* * *", "+ x | y",
        "| a | b |", "|--|--|", "--|--", "|", "||", ":-:|", "a | b", "# h | b", "- i | b", "[^1]: n | b", "---", "-- -", "___ ", "***x", "> q", ">", "> > qq", ">- i", "> [^1]: n", "> | a |", "[^1]: n", "[^]: no", "   [^a b]:", "3) x",
        "1234. x", "٣. arabic", "*em* and", "\x0b- tab", "　# wide", "\x85text more", "a\x0bb",
    ]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(14)))) for i in range(3000)]
    found = spark.createDataFrame(docs, "id long, text string").withColumn("pieces", textmd.pieces(F.col("text")))
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    for row in found.collect():
        want = [p for stretch in re.split(r"\n(?:\s*\n)+", row["text"]) if stretch.strip() for p in markdown_lines.pieces(stretch)]
        assert [p.asDict() for p in row["pieces"]] == want, row["text"]


def test_long_markdown_takes_linear_time(spark):
    import time

    for text in ("- item\n" * 150_000, "text | bar\n" * 150_000, "| a |\n|-|-|\n" * 80_000, "[^1]: n\n" * 150_000, "# " + "# " * 300_000, "# " + " " * 300_000 + "x", "|" * 300_000 + "x\n" + "|" * 300_000 + "x", "- " + " " * 300_000 + "x"):
        began = time.monotonic()
        spark.createDataFrame([(text,)], "text string").select(F.size(textmd.pieces(F.col("text")))).collect()
        assert time.monotonic() - began < 20, text[:10]


def test_plans_of_texts_have_no_python(spark):
    plan = textmd.text_blocks(spark.createDataFrame([(1, "# a\n\nb")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
