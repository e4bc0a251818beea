"""Formats, folder scans, line files."""

import io
import json
import os
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lodestream.sources import files, formats


def test_html_blocks_lists_tables_and_marks():
    page = """<html><head><title> A  title </title><style>x{}</style></head><body><h2>Head <b>bold</b></h2>
    <p>one<br>two <a href="/x?a=1&amp;b">a link</a>, <em> soft </em>&amp; <code>code</code></p><hr>
    <ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><ol start="3"><li>x</li><li>y</li></ol>
    <pre>  keep\n    this</pre><blockquote><p>said</p></blockquote><img src="i.png" alt="pic">
    <table><tr><th>h</th><th>i</th></tr><tr><td>1|2</td></tr></table><script>no()</script><p>unclosed"""
    d = formats.html_document(page)
    assert d.title == "A title" and d.links == ["/x?a=1&b"]
    assert d.markdown == "\n\n".join(["## Head **bold**", "one\ntwo [a link](/x?a=1&b), *soft* & `code`", "---", "- a\n  - b\n- c", "3. x\n4. y", "```\n  keep\n    this\n```", "> said", "![pic](i.png)", "| h | i |\n| --- | --- |\n| 1\\|2 |  |", "unclosed"])


def test_notes():
    d = formats.note('---\ntitle: "A: b" # c\ntags: [x, "y z"]\naliases:\n  - one\n---\n#tag/sub See [[N#h|words]], [[Other]] ![[p.png]] `#no` http://a/#no\n```\n#no [[no]]\n```', "file")
    assert (d.title, d.tags, d.links) == ("A: b", ["tag/sub", "x", "y z"], ["N", "Other", "p.png"])
    assert d.markdown == "#tag/sub See words, Other  `#no` http://a/#no\n```\n#no [[no]]\n```"
    assert formats.note("no head", "file").title == "file" and formats.front_matter("--- x") == ({}, "--- x")


def test_tables():
    assert formats.rows_of('a;b\n"x;1";2\n\n') == [["a", "b"], ["x;1", "2"]]
    assert formats.rows_of("a\tb,c\n1\t2\n") == [["a", "b,c"], ["1", "2"]]
    assert formats.rows_of('a,b\n"l1\nl2",""\n', ",") == [["a", "b"], ["l1\nl2", ""]]
    assert formats.table_of([["a", "b|c"], ["x\ny"]]) == "| a | b\\|c |\n| --- | --- |\n| x y |  |"
    assert formats.table_of([]) == ""


def test_wikitext():
    d = formats.wiki_document("<!-- c -->'''B''' is ''i'' [[X|y]] [[Z]]{{t|{{u}}}}<ref name=a>r</ref>\n== H ==\n* a\n** b\n# n\n{| class=x\n| cell\n|}\n[[Category:C]][[File:f.png|thumb]][http://a.b c]")
    assert d.markdown == "**B** is *i* y Z\n## H\n- a\n  - b\n1. n\n\n[c](http://a.b)" and (d.tags, d.links) == (["C"], ["X", "Z"])


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, props="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    item = lambda level: f'<w:numPr><w:ilvl w:val="{level}"/></w:numPr>'
    body = p("Top", '<w:pStyle w:val="Heading1"/>') + p("Text &amp; more") + p("a", item(0)) + p("b", item(1)) + f"<w:tbl><w:tr><w:tc>{p('h')}</w:tc><w:tc>{p('i')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("docProps/core.xml", '<x xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Named</dc:title></x>')
    return out.getvalue()


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<c xmlns="urn:x"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></c>')
        z.writestr("O/p.opf", '<package xmlns="urn:y" xmlns:dc="urn:dc"><dc:title>Book</dc:title><manifest><item id="b" href="t/b%20b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="x" href="gone.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="x"/></spine></package>')
        z.writestr("O/a.xhtml", "<h1>One</h1><p>first</p>")
        z.writestr("O/t/b b.xhtml", "<p>second</p>")
    return out.getvalue()


def pdf():
    stream = zlib.compress(b"BT /F1 12 Tf (Hello \\(you\\)) Tj T* [(wor) -20 (ld)] TJ ET")
    return b"%PDF-1.4\n1 0 obj <</Length 1/Filter/FlateDecode>>\nstream\n" + stream + b"\nendstream endobj"


def test_office_book_rtf_and_pdf():
    d = formats.extract("f.docx", "docx", docx())
    assert (d.title, d.markdown) == ("Named", "# Top\n\nText & more\n\n- a\n  - b\n\n| h | i |\n| --- | --- |")
    d = formats.extract("f.epub", "epub", epub())
    assert (d.title, d.markdown, d.warnings) == ("Book", "# One\n\nfirst\n\nsecond", ["missing chapter O/gone.xhtml"])
    assert formats.resolved("O/p.opf", "../x/./y%20z#f") == "x/y z"
    assert formats.rtf_document(r"{\rtf1{\fonttbl{\f0 A;}}Hello \b W\b0\par caf\'e9 " + chr(92) + r"u8364? {\*\x y}\{z\}}").markdown == "Hello W\n\ncafé € {z}"
    assert formats.extract("f.pdf", "pdf", pdf()).markdown == "Hello (you)\nworld"


@pytest.mark.parametrize("kind", [k for kinds in formats.CATEGORIES.values() for k in kinds] + ["", "txt", None])
@pytest.mark.parametrize("data", [b"", b"plain text", b"\x00\x01\x02", b"PK\x03\x04broken", b"{\\rtf1 {{{", b"<a <b", "é".encode("cp1252"), b"\xef\xbb\xbfx"])
def test_extraction_never_raises(kind, data):
    d = formats.extract(f"name.{kind}", kind, data)
    assert d.title is not None and (d.markdown is not None or d.warnings)


def test_decoding():
    assert formats.decoded("é\r\nx".encode("utf-16")) == "é\nx" and formats.decoded("é".encode("cp1252")) == "é" and formats.decoded(b"\xef\xbb\xbfa") == "a"


def test_scan_and_documents(spark, tmp_path):
    for name, data in {"a.md": b"# A\n#t [[B]]", "sub dir/b.html": b"<title>T</title><p>x", "sub dir/.hidden.md": b"no", ".git/c.md": b"no", "out/d.md": b"no", "big.txt": b"x" * 2000, "bad.docx": b"not a zip", "e.csv": b"a,b\n1,2", "skip.tmp": b"no", "empty.txt": b"", "blank.txt": b" "}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    found = files.scan(spark, str(tmp_path), extensions=["md", "html", "txt", "docx", "csv"], without_folders=["out"], without_names=["skip%"], most_bytes=1000)
    rows = {r.path: r for r in found.collect()}
    assert set(rows) == {"a.md", "sub dir/b.html", "big.txt", "bad.docx", "e.csv", "blank.txt"}
    assert rows["big.txt"].status == "error" and "1000" in rows["big.txt"].message and rows["a.md"].fingerprint == f"12:{int(os.path.getmtime(tmp_path / 'a.md'))}"
    out = {r.path: r for r in files.documents(found, str(tmp_path)).collect()}
    assert set(out) == set(rows) - {"big.txt"}
    assert (out["a.md"].markdown, out["a.md"].tags, out["a.md"].links) == ("# A\n#t B", ["t"], ["B"])
    assert (out["sub dir/b.html"].title, out["sub dir/b.html"].markdown) == ("T", "x")
    assert out["bad.docx"].markdown == "not a zip" and out["bad.docx"].message.startswith("read as plain text")
    assert out["blank.txt"].status == "empty" and out["e.csv"].status == "synced"


def test_line_files_and_log_text(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", None), (2, None, [1, 2])], "id long, t string, xs array<int>")
    files.write_lines(frame, str(tmp_path / "o"))
    lines = sorted(line for p in (tmp_path / "o").glob("*.json") for line in p.read_text().splitlines())
    assert json.loads(lines[0]) == {"id": 1, "t": "a", "xs": None}
    (tmp_path / "in.jsonl").write_text('{"id": 3, "t": "z"}\n{"id": "no number"}\nbroken\n')
    rows = files.read_lines(spark, str(tmp_path / "in.jsonl"), "id long, t string").collect()
    assert (rows[0].id, rows[0].t, rows[0]._corrupt) == (3, "z", None) and rows[2]._corrupt == "broken" and rows[1].id is None
    logs = spark.createDataFrame([("2024-01-01 00:00:01", "info", "net", "two\nlines"), ("2024-01-01 00:00:00", "error", "db", "x")], "ts string, level string, category string, message string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.value for r in files.log_text(logs).collect()] == ["2024-01-01T00:00:00.000 [ERROR] db: x", "2024-01-01T00:00:01.000 [INFO] net: two lines"]


def test_names_that_look_encoded_are_files_of_their_own(spark, tmp_path):
    names = ["a b.txt", "a%20b.txt", "a%25b.txt", "é+ü.txt"]
    for n in names:
        (tmp_path / n).write_text(n)
    found = files.scan(spark, str(tmp_path))
    assert sorted(r.path for r in found.collect()) == sorted(names)
    assert {r.path: r.markdown for r in files.documents(found, str(tmp_path)).collect()} == {n: n for n in names}
