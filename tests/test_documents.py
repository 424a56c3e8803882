import io
import random
import uuid
import zipfile

import pytest

from quillspark.operators import versions
from quillspark.sources import readers
from quillspark.sources.readers import ReaderFailure
from quillspark.streaming.delivery import retry_delay


def test_text_and_csv():
    assert list(readers.read_text("﻿a\r\n\r\nが".encode())) == [("Line", '{"line":0}', "a"), ("Line", '{"line":2}', "が")]
    assert [u[2] for u in readers.read_text("表".encode("cp932"), "windows-31j")] == ["表"]
    assert [(u[1], u[2]) for u in readers.read_csv(b'a,"b,c"\n,d\n')] == [('{"record":0,"field":0}', "a"), ('{"record":0,"field":1}', "b,c"), ('{"record":1,"field":1}', "d")]
    for raw, reader in ((b"\xff", readers.read_text), (b"a;b\n", readers.read_csv), (b"a,b\nc\n", readers.read_csv)):
        with pytest.raises(ReaderFailure):
            list(reader(raw))


def test_html():
    units = list(readers.read_html(b"<html><head><title>t</title></head><body><h1>A<br>b</h1><p>c &amp; d</p></body></html>"))
    assert [(u[0], u[2]) for u in units] == [("Heading", "A"), ("Heading", "b"), ("Text", "c & d")]
    for bad in ("<script>x</script>", "<p hidden>x</p>", "<p style='a'>x</p>", "<link rel=stylesheet>", "<div>" * 300):
        with pytest.raises(ReaderFailure):
            list(readers.read_html(f"<body>{bad}</body>".encode()))


def test_what_the_readers_refuse_and_allow():
    with pytest.raises(ReaderFailure, match="UnsupportedEncoding"):
        list(readers.read_text("éabc".encode("latin-1"), "latin-1"))
    assert [u[2] for u in readers.read_html(b"<title>t</title></head><p>a</p>")] == ["a"]
    assert [u[2] for u in readers.read_html(b"<!DOCTYPE html><html><p>b<p>c")] == ["b", "c"]


def test_parts_in_order_and_broken_cells():
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = lambda cell: f"<worksheet {s}><sheetData><row>{cell}</row></sheetData></worksheet>"
    book = {"xl__workbook_dot_xml": f'<workbook {s} {r}><sheets><sheet r:id="b"/><sheet r:id="a"/></sheets></workbook>',
            "xl___rels__workbook_dot_xml_dot_rels": '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>'}
    one, two = ('<c r="A1" t="inlineStr"><is><t>%s</t></is></c>' % t for t in ("one", "two"))
    raw = archive(xl__worksheets__sheet1_dot_xml=sheet(one), xl__worksheets__sheet2_dot_xml=sheet(two), **book)
    assert [(u[1], u[2]) for u in readers.read_leaf("xlsx", raw)] == [('{"sheet":0,"row":0,"column":0}', "two"), ('{"sheet":1,"row":0,"column":0}', "one")]
    for cell in ("<c><v>1</v></c>", '<c r="A1" t="s"><v>7</v></c>'):
        with pytest.raises(ReaderFailure, match="Corrupt"):
            readers.read_leaf("xlsx", archive(xl__worksheets__sheet1_dot_xml=sheet(cell)))


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def test_containers():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = archive(word__document_dot_xml=f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    assert readers.read_leaf("docx", docx) == [("Paragraph", '{"block":0}', "One"), ("Cell", '{"block":1,"row":0,"cell":0}', "x")]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    xlsx = archive(xl__worksheets__sheet1_dot_xml=f'<worksheet {s}><sheetData><row><c r="B3" t="inlineStr"><is><t>v</t></is></c><c r="C3"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>')
    assert readers.read_leaf("xlsx", xlsx) == [("Cell", '{"sheet":0,"row":2,"column":1}', "v")]
    plan = {"a.txt": ("text", "utf-8")}
    assert len(list(readers.read_zip(archive(a_dot_txt="x\ny"), plan))) == 2
    for members in (archive(a_dot_txt="x", b_dot_txt="y"), archive()):
        with pytest.raises(ReaderFailure):
            list(readers.read_zip(members, plan))
    with pytest.raises(ReaderFailure):
        readers.read_leaf("docx", b"broken")


def test_json():
    assert versions.json_changes({"a": {"b": 1}, "c/d": [1]}, {"a": {"b": 2}, "e~": None}) == [("/a/b", "1", "2"), ("/c~1d", "[1]", None), ("/e~0", None, "null")]
    assert versions.json_changes(1, True) == [("", "1", "true")]
    with pytest.raises(ValueError):
        versions.parse_unique('{"a":1,"a":1}')


def test_tables():
    rows = [["a", "1"], ["b", "2"], ["c", "3"]]
    assert versions.compare_rows(rows, rows) == []
    assert [c[0] for c in versions.compare_rows(rows, rows[::-1])] == ["Reordered", "Reordered"]
    assert versions.compare_rows(rows, [*rows[:1], ["b", "9"], *rows[2:]]) == [("Modified", 1, 1, "2", "9")]
    assert [c[0] for c in versions.compare_rows(rows, rows[:2])] == ["Removed"]
    assert versions.compare_rows([["a"], ["a"]], rows)[0][0] == "Ambiguous"
    assert versions.compare_rows([["a"], ["a"]], [["a"], ["b"]])[0][0] == "Ambiguous"
    assert [c[0] for c in versions.compare_rows([["a"], ["a"]], [["a"], ["a"], ["b"]])] == ["Added"]
    assert versions.unique_delimiter("a,b\nc,d") == "," and versions.unique_delimiter("a;b,c\nd;e,f") is None


def test_lifecycle(spark):
    rows = [("d", 1, "publish"), ("d", 2, "withdraw"), ("d", 3, "publish"), ("e", 1, "end")]
    got = {(r.document, r.state, r.refused) for r in versions.lifecycle(spark.createDataFrame(rows, "document string, seq long, operation string")).collect()}
    assert got == {("d", "WITHDRAWN", 1), ("e", "WORKING", 1)}


def test_rejected_items_have_a_reason(spark):
    items = spark.createDataFrame([(1, "text", "utf-8", bytearray(b"a\nb")), (2, "pdf", None, bytearray(b"x")), (3, "text", None, None)], "item long, format string, charset string, raw binary")
    got = sorted((r.item, r.state, r.reason or "", r.text or "") for r in readers.extract_units(items).collect())
    assert got == [(1, "Supported", "", "a"), (1, "Supported", "", "b"), (2, "Unsupported", "UnsupportedFormat", ""), (3, "Supported", "", "")]


def test_retry_delay():
    rng = random.Random(1)
    for attempt in range(1, 10):
        base = 2.0 ** (attempt - 1)
        assert base <= retry_delay(uuid.UUID(int=rng.getrandbits(128)), attempt) <= min(300, base * 1.25)
    assert retry_delay(uuid.UUID(int=1), 10) == 300
