"""Readers of located text units: text, CSV, HTML, and OOXML and ZIP containers.

A unit is one fragment of text with a locator.  An item yields units and
coverage, and a budget that is exceeded rejects the whole item.
"""

from __future__ import annotations

import csv
import io
import json
import re
import unicodedata
import zipfile
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame, functions as F

Unit = tuple[str, str, str]  # kind, locator as JSON, text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DYNAMIC, DEEPEST = frozenset(("script", "style", "template")), 256
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
SLIDES = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
RELATIONS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


class ReaderFailure(ValueError):
    """An item that gives no units; the message is the reason."""


def normalize(text: str) -> str:
    """CRLF and CR become LF, then NFC."""
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n"))


def _locator(**parts) -> str:
    return json.dumps(parts, separators=(",", ":"))


def decode(raw: bytes, charset: str) -> str:
    """Strict UTF-8 (a mark at the start is dropped) or Windows-31J; no other."""
    if charset not in ("utf-8", "windows-31j"):
        raise ReaderFailure("UnsupportedEncoding")
    try:
        return raw.decode("utf-8").removeprefix("﻿") if charset == "utf-8" else raw.decode("cp932")
    except UnicodeDecodeError:
        raise ReaderFailure("UnsupportedEncoding") from None


def read_text(raw: bytes, charset: str = "utf-8") -> Iterator[Unit]:
    for i, line in enumerate(normalize(decode(raw, charset)).split("\n")):
        if line:
            yield "Line", _locator(line=i), line


def read_csv(raw: bytes, charset: str = "utf-8") -> Iterator[Unit]:
    text = decode(raw, charset)
    if ";" in text.split("\n", 1)[0]:
        raise ReaderFailure("UnsupportedDialect")
    rows = list(csv.reader(io.StringIO(text), strict=True))
    if len({len(r) for r in rows}) > 1:
        raise ReaderFailure("RaggedRows")
    for r, row in enumerate(rows):
        for f, value in enumerate(row):
            if value:
                yield "Cell", _locator(record=r, field=f), normalize(value)


class _Body(HTMLParser):
    """Text nodes below body with their child-index paths."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = []
        self.units: list[Unit] = []
        self.body = 0

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.body = len(self.stack) + 1
        inside = 0 < self.body <= len(self.stack)
        names = dict(attrs)
        if inside and (tag in DYNAMIC or "hidden" in names or "style" in names or tag == "link" and "stylesheet" in (names.get("rel") or "")):
            raise ReaderFailure("DynamicVisibility")
        if self.stack:
            self.stack[-1][1] += 1
        if len(self.stack) >= DEEPEST:
            raise ReaderFailure("ResourceLimit")
        if tag not in VOID:
            self.stack.append([tag, -1])

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.stack:
            self.stack[-1][1] += 1
        text = normalize(data).strip()
        if text and 0 < self.body <= len(self.stack):
            heading = any(re.fullmatch("h[1-6]", t) for t, _ in self.stack)
            self.units.append(("Heading" if heading else "Text", _locator(path=[n for _, n in self.stack[self.body - 1 :]]), text))


def read_html(raw: bytes, charset: str = "utf-8") -> Iterator[Unit]:
    """Text below body; where its tag is left out, it begins after the head."""
    text = decode(raw, charset)
    if not re.search(r"(?i)<body[\s/>]", text):
        head = re.search(r"(?is)^.*?</head\s*>|^\s*(?:<!doctype[^>]*>)?\s*(?:<html[^>]*>)?", text)
        text = text[: head.end()] + "<body>" + text[head.end() :]
    parser = _Body()
    parser.feed(text)
    parser.close()
    yield from parser.units


def _archive(raw: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        raise ReaderFailure("Corrupt") from None


def _xml(archive: zipfile.ZipFile, name: str):
    try:
        return ElementTree.fromstring(archive.read(name))
    except (KeyError, ElementTree.ParseError):
        raise ReaderFailure("Corrupt") from None


def _parts_in_order(archive: zipfile.ZipFile, folder: str, main: str, tag: str, pattern: str) -> list[str]:
    """Parts in the order in which the main part refers to them; by number where it does not say."""
    numbered = sorted((n for n in archive.namelist() if re.fullmatch(f"{folder}/{pattern}", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    relations = f"{folder}/_rels/{main}.rels"
    if not {f"{folder}/{main}", relations} <= set(archive.namelist()):
        return numbered
    targets = {r.get("Id"): (r.get("Target") or "").lstrip("/") for r in _xml(archive, relations)}
    named = [targets.get(item.get(f"{RELATIONS}id"), "") for item in _xml(archive, f"{folder}/{main}").iter(tag)]
    found = [t if t.startswith(folder + "/") else f"{folder}/{t}" for t in named if t]
    return [n for n in found if n in archive.namelist()] if found else numbered


def read_docx(raw: bytes) -> Iterator[Unit]:
    """Main body by block, and by row and cell in tables."""
    body = _xml(_archive(raw), "word/document.xml").find(f"{WORD}body")
    text = lambda node: normalize("".join(t.text or "" for t in node.iter(f"{WORD}t")))
    for b, block in enumerate(body if body is not None else ()):
        if block.tag == f"{WORD}p" and text(block):
            yield "Paragraph", _locator(block=b), text(block)
        elif block.tag == f"{WORD}tbl":
            for r, row in enumerate(block.findall(f"{WORD}tr")):
                for c, cell in enumerate(row.findall(f"{WORD}tc")):
                    if text(cell):
                        yield "Cell", _locator(block=b, row=r, cell=c), text(cell)


def read_xlsx(raw: bytes) -> Iterator[Unit]:
    """Cells in workbook order with absolute places; formula cells are left out."""
    archive = _archive(raw)
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in _xml(archive, "xl/sharedStrings.xml").findall(f"{SHEET}si")]
    for s, name in enumerate(_parts_in_order(archive, "xl", "workbook.xml", f"{SHEET}sheet", r"worksheets/sheet(\d+)\.xml")):
        for cell in _xml(archive, name).iter(f"{SHEET}c"):
            value = cell.find(f"{SHEET}v")
            if cell.find(f"{SHEET}f") is not None:
                continue
            inline = "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
            text = inline or (value.text or "" if value is not None else "")
            if cell.get("t") == "s" and value is not None:
                if not (value.text or "").isdecimal() or int(value.text) >= len(shared):
                    raise ReaderFailure("Corrupt")
                text = shared[int(value.text)]
            place = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r") or "")
            if place is None:
                raise ReaderFailure("Corrupt")
            column = 0
            for letter in place[1]:
                column = column * 26 + ord(letter) - 64
            if text:
                yield "Cell", _locator(sheet=s, row=int(place[2]) - 1, column=column - 1), normalize(text)


def read_pptx(raw: bytes) -> Iterator[Unit]:
    """Paragraphs of the slides in the presentation's order."""
    archive = _archive(raw)
    for s, name in enumerate(_parts_in_order(archive, "ppt", "presentation.xml", f"{SLIDES}sldId", r"slides/slide(\d+)\.xml")):
        for p, paragraph in enumerate(_xml(archive, name).iter(f"{DRAWING}p")):
            text = normalize("".join(t.text or "" for t in paragraph.iter(f"{DRAWING}t")))
            if text:
                yield "Paragraph", _locator(slide=s, paragraph=p), text


LEAF = {"text": read_text, "csv": read_csv, "html": read_html}
CONTAINER = {"docx": read_docx, "xlsx": read_xlsx, "pptx": read_pptx}


def read_zip(raw: bytes, plan: dict[str, tuple[str, str]]) -> Iterator[Unit]:
    """Members by a registered plan {name: (format, charset)}; a member or plan entry without the other rejects all."""
    archive = _archive(raw)
    members = {n for n in archive.namelist() if not n.endswith("/")}
    if members != plan.keys():
        raise ReaderFailure("UnregisteredMember" if members - plan.keys() else "UnusedPlanNode")
    for name in sorted(plan):
        for kind, locator, text in read_leaf(plan[name][0], archive.read(name), plan[name][1]):
            yield kind, json.dumps({"member": name, "inner": json.loads(locator)}, separators=(",", ":")), text


def read_leaf(format_: str, raw: bytes, charset: str = "utf-8") -> list[Unit]:
    if format_ in LEAF:
        return list(LEAF[format_](raw, charset))
    if format_ in CONTAINER:
        return list(CONTAINER[format_](raw))
    raise ReaderFailure("UnsupportedFormat")


def detect_ooxml(raw: bytes) -> str | None:
    """docx, pptx, xlsm or xlsx by content types and part names."""
    try:
        names = zipfile.ZipFile(io.BytesIO(raw)).namelist()
    except zipfile.BadZipFile:
        return None
    if "[Content_Types].xml" not in names:
        return None
    if "xl/workbook.xml" in names:
        return "xlsm" if "xl/vbaProject.bin" in names else "xlsx"
    return "docx" if "word/document.xml" in names else "pptx" if "ppt/presentation.xml" in names else None


def extract_units(items: DataFrame, max_units: int = 1_000_000, max_bytes: int = 1 << 30) -> DataFrame:
    """item, state, reason, ordinal, kind, locator, text of ``items`` (item, format, charset, raw).

    Rejected items have one row with their reason and no text.
    """
    def run(batches: Iterable):
        import pyarrow as pa

        names = ["item", "state", "reason", "ordinal", "kind", "locator", "text"]
        types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            for item, format_, charset, raw in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    units = read_leaf(format_, raw or b"", charset or "utf-8")
                    if len(units) > max_units or sum(len(u[2].encode()) for u in units) > max_bytes:
                        raise ReaderFailure("ResourceLimit")
                    out = [(item, "Supported", None, i, *u) for i, u in enumerate(units)] or [(item, "Supported", None, None, None, None, None)]
                except (ReaderFailure, csv.Error) as failure:
                    out = [(item, "Unsupported", str(failure), None, None, None, None)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return items.select(F.col("item").cast("long"), "format", "charset", F.col("raw").cast("binary")).mapInArrow(run, "item long, state string, reason string, ordinal int, kind string, locator string, text string")


def resolve_locators(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """Units (item, locator, text) in the order of ``wanted`` (item, locator, position); missing or repeated ones raise."""
    found = wanted.join(units.select("item", "locator", "text"), ["item", "locator"], "left")
    bad = found.groupBy("item", "locator", "position").agg(F.count("text").alias("n")).where("n <> 1").limit(1)
    if bad.count():
        raise ReaderFailure("UnresolvedLocator")
    return found.orderBy("position")
