"""Files to blocks: one function a format, from bytes to (kind, level, text, rows).

A block is a heading (with a level), a paragraph, a list item, a quote, code, a rule, or a table (rows of cells); bold,
italic, struck and code runs, links and images in its text are Markdown. Decoders run
in Arrow batches behind `decode_files`; what they can't read becomes a typed error row, never an exception.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import lzma
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from email import message_from_bytes, policy
from html.parser import HTMLParser
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import FOLD_KEEP, QUOTE_MARKS

from . import legacy
from .tables import bounded_batches


class Block(NamedTuple):
    kind: str
    level: int
    text: str
    rows: list[list[str]] | None = None


class DecodeError(Exception):
    """code: conversion_error, unsupported_format, needs_ocr, malformed_document, encrypted_document, resource_limit, missing_part."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(detail)
        self.code = code


# Budgets of archives, sheets and mails, destination groups of RTF that hold no text, fonts of headings in OFD.
MAX_ENTRIES, MAX_BYTES, MAX_DEPTH = 100_000, 2 << 30, 3
MAX_ROWS, MAX_CELLS, MAX_CHARS, MAX_COLUMNS, MAX_SHEETS = 3000, 200_000, 120_000, 80, 20
MAX_ATTACHED, MAX_ATTACHED_ALL, MAX_ATTACHED_CHARS, MAX_MAIL_CHARS, MAX_NESTED = 50 << 20, 150 << 20, 120_000, 400_000, 1
HEADING_FONTS = {"黑体", "方正黑体_GBK", "方正小标宋_GBK", "方正小标宋简体", "方正小标宋", "方正书宋", "方正大标宋", "宋体", "SimSun"}
BATCH_CHARS = 4 << 20
RTF_SKIP = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "generator", "themedata", "listtable", "listoverridetable", "rsidtbl", "xmlnstbl", "datastore", "latentstyles"}


def text_of(content: bytes) -> str:
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def decode_text(content: bytes) -> list[Block]:
    body = re.sub(r"\r\n?", "\n", text_of(content)).strip()
    return [Block("p", 0, body)] if body else []


def decode_csv(content: bytes) -> list[Block]:
    rows = [r for r in csv.reader(io.StringIO(re.sub(r"\r\n?", "\n", text_of(content)), newline=""))]
    width = max(map(len, rows), default=0)
    return [Block("table", 0, "", [r + [""] * (width - len(r)) for r in rows])] if width else []


class _Html(HTMLParser):
    SKIP = {"script", "style", "noscript", "iframe", "svg", "head"}
    MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "s": "~~", "del": "~~", "strike": "~~", "code": "`"}
    BREAK = {"p", "div", "section", "article", "header", "footer", "nav", "main", "aside", "ul", "ol", "table", "blockquote", "body", "form", "figure", "pre", "dl", "dt", "dd", "address"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.skip = 0
        self.kind, self.level = "p", 0
        self.lists: list[list] = []
        self.rows: list[list[str]] | None = None
        self.href = ""
        self.cell = False
        self.open: list[tuple[str, int]] = []  # marks that are open, and where their text starts
        self.pre = 0

    def marked(self, tag: str) -> None:
        """Puts the mark of a tag that ends around its text, inside white space; text without a word gets none."""
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if at is None:
            return
        _, start = self.open[at]
        del self.open[at:]
        inner = "".join(self.text[start:])
        mark, body = self.MARKS[tag], inner.strip()
        if body and not (body.startswith(mark) and body.endswith(mark)):
            lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
            self.text[start:] = [lead, mark, body, mark, tail]

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)

    def end_cell(self) -> None:
        for tag, _ in reversed(self.open):
            self.marked(tag)
        if self.cell and self.rows:
            self.rows[-1].append(" ".join("".join(self.text).split()))
        self.text.clear()
        self.cell = False

    def flush(self, kind: str = "p", level: int = 0) -> None:
        for tag, _ in reversed(self.open):
            self.marked(tag)
        joined = " ".join("".join(self.text).split())
        self.text.clear()
        if joined and self.rows is None:
            self.blocks.append(Block(self.kind, self.level, joined))
        self.kind, self.level = kind, level

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        if self.skip:
            return
        at = dict(attrs)
        if re.fullmatch("h[1-6]", tag):
            self.flush("h", int(tag[1]))
        elif tag == "li":
            self.flush("li", max(0, len(self.lists) - 1))
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                self.text.append(f"{self.lists[-1][1]}. ")
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append([tag, 0])
        elif tag == "table" and self.rows is None:
            self.flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.end_cell()
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.end_cell()
            self.cell = True
        elif tag == "br":
            self.text.append("\n" if self.pre else " ")
        elif tag == "pre" and self.rows is None:
            self.flush()
            self.pre += 1
        elif tag == "hr" and self.rows is None:
            self.flush()
            self.blocks.append(Block("hr", 0, ""))
        elif tag in self.MARKS and not self.pre:
            self.open.append((tag, len(self.text)))
        elif tag == "blockquote":
            self.flush("quote")
        elif tag == "a":
            self.href = at.get("href") or ""
            self.text.append("[" if self.href else "")
        elif tag == "img" and at.get("src"):
            self.text.append(f"![{at.get('alt') or ''}]({at['src']})")
        elif tag in self.BREAK and self.rows is None:
            self.flush("quote" if self.kind == "quote" and tag == "p" else "p")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in self.MARKS:
            self.marked(tag)
        elif tag == "pre" and self.pre and self.rows is None:
            self.pre -= 1
            code = "".join(self.text).strip("\n")
            self.text.clear()
            if code.strip():
                self.blocks.append(Block("code", 0, code))
        elif tag in ("td", "th") and self.rows:
            self.end_cell()
        elif tag == "table" and self.rows is not None:
            self.end_cell()
            rows, self.rows = [r for r in self.rows if any(r)], None
            if rows:
                self.blocks.append(Block("table", 0, "", rows))
        elif tag == "a" and self.href:
            self.text.append(f"]({self.href})")
            self.href = ""
        elif tag in ("ul", "ol"):
            self.flush()
            if self.lists:
                self.lists.pop()
        elif (tag in self.BREAK or tag == "li" or re.fullmatch("h[1-6]", tag)) and self.rows is None:
            self.flush()


def decode_html(content: bytes) -> list[Block]:
    page = re.sub(r"<!\[(?:if|endif)[^>]*\]>", "", text_of(content))
    parser = _Html()
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.blocks


def decode_rtf(content: bytes) -> list[Block]:
    out: list[str] = []
    raw = bytearray()
    codec, skip_next = "cp1252", 0
    stack: list[bool] = []
    hidden = False

    def bytes_out() -> None:
        if raw:
            out.append(bytes(raw).decode(codec, "replace"))
            raw.clear()

    for m in re.finditer(rb"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}\r\n])", content, re.S):
        word, number, code, symbol, brace, char = m.groups()
        if code is None:
            bytes_out()
        if brace == b"{":
            stack.append(hidden)
        elif brace == b"}":
            hidden = stack.pop() if stack else False
        elif symbol == b"*" or word and word.decode() in RTF_SKIP:
            hidden = True
        elif hidden:
            continue
        elif word == b"ansicpg" and number:
            codec = "gb18030" if number == b"936" else f"cp{number.decode()}"
        elif word == b"u" and number:
            out.append(chr(int(number) % 65536))
            skip_next = 1
        elif word in (b"par", b"line", b"sect"):
            out.append("\n")
        elif word in (b"tab", b"cell"):
            out.append("\t")
        elif code:
            if skip_next:
                skip_next = 0
            else:
                raw.append(int(code, 16))
        elif symbol in (b"\\", b"{", b"}"):
            out.append(symbol.decode())
        elif symbol == b"~":
            out.append("\u00a0")
        elif char:
            if skip_next:
                skip_next = 0
            else:
                raw.append(char[0])
    bytes_out()
    text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return [Block("p", 0, x.strip()) for x in text.split("\n") if x.strip()]


def _xml(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data[:2000]:
        raise DecodeError("malformed_document", "document type in a part")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise DecodeError("malformed_document", str(e)) from e


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _zip(content: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise DecodeError("malformed_document", str(e)) from e
    if any(i.flag_bits & 1 for i in z.infolist()):
        raise DecodeError("encrypted_document")
    if len(z.infolist()) > MAX_ENTRIES or sum(i.file_size for i in z.infolist()) > MAX_BYTES:
        raise DecodeError("resource_limit", "entries or bytes")
    return z


def _part(z: zipfile.ZipFile, name: str) -> bytes:
    try:
        return z.read(name)
    except KeyError as e:
        raise DecodeError("missing_part", name) from e


def _runs(p: ElementTree.Element) -> str:
    out = []
    for r in p.iter():
        if _local(r) == "t":
            out.append(r.text or "")
        elif _local(r) in ("tab", "br", "cr"):
            out.append(" ")
    return "".join(out)


def _marked_runs(p: ElementTree.Element) -> str:
    """The text of a paragraph, its bold, italic and struck runs in marks; runs that are alike go together."""
    out: list[tuple[tuple[bool, bool, bool], str]] = []
    for r in (x for x in p.iter() if _local(x) == "r"):
        text = _runs(r)
        props = next((x for x in r if _local(x) == "rPr"), None)
        on = tuple(any(_local(x) == name and _attr(x, "val") not in ("0", "false", "none") for x in (props if props is not None else ())) for name in ("b", "i", "strike"))
        if text:
            if out and out[-1][0] == on:
                out[-1] = (on, out[-1][1] + text)
            else:
                out.append((on, text))
    done = []
    for on, text in out:
        body = text.strip()
        for mark in (m for m, yes in zip(("**", "*", "~~"), on, strict=True) if yes and body):
            body = f"{mark}{body}{mark}"
        done.append(text[: len(text) - len(text.lstrip())] + body + text[len(text.rstrip()) :] if body else text)
    return "".join(done)


def _attr(e: ElementTree.Element | None, name: str) -> str:
    return next((v for k, v in (e.attrib if e is not None else {}).items() if k.rpartition("}")[2] == name), "")


def _find(e: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((x for x in e.iter() if _local(x) == name), None)


def decode_docx(content: bytes) -> list[Block]:
    body = _find(_xml(_part(_zip(content), "word/document.xml")), "body")
    out: list[Block] = []
    for e in body if body is not None else []:
        if _local(e) == "p":
            text = _runs(e).strip()
            shown = _marked_runs(e).strip() or text
            style = _attr(_find(e, "pStyle"), "val")
            head = re.fullmatch(r"(?:Heading|标题)\s*([1-6])", style, re.I)
            number = _attr(_find(e, "numId"), "val")
            if text and head:
                out.append(Block("h", int(head[1]), text))
            elif text and (number not in ("", "0") or style.startswith("List")) and not re.match(r"(?:\d+[.)、]|[（(]\d+[)）])", text):
                out.append(Block("li", int(_attr(_find(e, "ilvl"), "val") or 0), shown))
            elif text:
                out.append(Block("p", 0, shown))
        elif _local(e) == "tbl":
            rows = []
            for tr in (x for x in e if _local(x) == "tr"):
                cells = []
                for tc in (x for x in tr if _local(x) == "tc"):
                    span = int(_attr(_find(tc, "gridSpan"), "val") or 1)
                    cells += ["\n".join(_runs(p) for p in tc if _local(p) == "p").strip()] + [""] * (span - 1)
                if any(cells):
                    rows.append(cells)
            if rows:
                out.append(Block("table", 0, "", rows))
    return out


def _sheet_names(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    links = {_attr(r, "Id"): _attr(r, "Target") for r in _xml(_part(z, "xl/_rels/workbook.xml.rels"))}
    return [(_attr(s, "name"), links.get(_attr(s, "id"), "")) for s in _xml(_part(z, "xl/workbook.xml")).iter() if _local(s) == "sheet"]


def limit_rows(rows: Iterator[list[str]]) -> tuple[list[list[str]], str]:
    """Rows within the budgets, and the first budget that was met."""
    kept: list[list[str]] = []
    cells = chars = 0
    reason = ""
    for row in rows:
        row = [c for c in row]
        while row and not row[-1]:
            row.pop()
        if not row:
            continue
        if len(row) > MAX_COLUMNS:
            row, reason = row[:MAX_COLUMNS], reason or "columns"
        over = "rows" if len(kept) >= MAX_ROWS else "cells" if cells + len(row) > MAX_CELLS else "characters" if chars >= MAX_CHARS else ""
        if over:
            return kept, reason or over
        kept.append(row)
        cells += len(row)
        chars += sum(map(len, row))
    return kept, reason


def decode_xlsx(content: bytes) -> list[Block]:
    z = _zip(content)
    shared = [_runs(si) for si in _xml(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []

    def cell(c: ElementTree.Element) -> str:
        kind, v = _attr(c, "t"), _find(c, "v")
        value = (v.text or "") if v is not None else ""
        if kind == "s":
            return shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
        if kind == "inlineStr":
            return _runs(c)
        if kind == "b":
            return "TRUE" if value == "1" else "FALSE"
        return re.sub(r"\.0$", "", value)

    def rows(sheet: ElementTree.Element) -> Iterator[list[str]]:
        for r in (x for x in sheet.iter() if _local(x) == "row"):
            out: list[str] = []
            for c in (x for x in r if _local(x) == "c"):
                letters = re.match("[A-Z]+", _attr(c, "r"))
                at = len(out)
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                out += [""] * (min(at, 16384) - len(out))
                out.append(cell(c))
            yield out

    out: list[Block] = []
    for name, target in _sheet_names(z)[:MAX_SHEETS]:
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        kept, reason = limit_rows(rows(_xml(_part(z, path))))
        out.append(Block("h", 1, name))
        if kept:
            width = max(map(len, kept))
            out.append(Block("table", 0, "", [r + [""] * (width - len(r)) for r in kept]))
        if reason:
            out.append(Block("quote", 0, f"cut at the limit of {reason}"))
    return out


def decode_pptx(content: bytes) -> list[Block]:
    z = _zip(content)
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
    out: list[Block] = []
    for k, name in enumerate(slides, 1):
        root = _xml(z.read(name))
        out.append(Block("h", 2, f"{k}"))
        tables = [t for t in root.iter() if _local(t) == "tbl"]
        inside = {id(p) for t in tables for p in t.iter()}
        out += [Block("p", 0, text) for p in root.iter() if _local(p) == "p" and id(p) not in inside and (text := _runs(p).strip())]
        for t in tables:
            rows = [[_runs(c).strip() for c in r if _local(c) == "tc"] for r in t.iter() if _local(r) == "tr"]
            out.append(Block("table", 0, "", rows))
        notes = f"ppt/notesSlides/notesSlide{number(name)}.xml"
        if notes in z.namelist():
            out += [Block("quote", 0, text) for p in _xml(z.read(notes)).iter() if _local(p) == "p" and (text := _runs(p).strip())]
    return out


def decode_odt(content: bytes) -> list[Block]:
    out = []
    for e in _xml(_part(_zip(content), "content.xml")).iter():
        if _local(e) in ("h", "p"):
            text = "".join(e.itertext()).strip()
            if text:
                out.append(Block("h" if _local(e) == "h" else "p", int(_attr(e, "outline-level") or 1) if _local(e) == "h" else 0, text))
    return out


class _Fragment(NamedTuple):
    x: float
    y: float
    size: float
    font: str
    text: str


def _numbers(text: str, n: int) -> list[float]:
    try:
        found = [float(v) for v in text.split()]
    except ValueError:
        found = []
    return found if len(found) == n else []


def _ofd_fragment(o: ElementTree.Element, fonts: dict[str, str]) -> _Fragment | None:
    """A text object where it stands on the page: by its transformation, or by its offset in its boundary."""
    code = _find(o, "TextCode")
    text = ((code.text if code is not None else "") or "").strip()
    if not text:
        return None
    left, top, _, height = _numbers(_attr(o, "Boundary"), 4) or (0.0, 0.0, 0.0, 4.0)
    offset = _numbers(f"{_attr(code, 'X')} {_attr(code, 'Y')}", 2)
    matrix = _numbers(_attr(o, "CTM"), 6)
    if offset and matrix:
        (x, y), (a, b, c, d, e, f) = offset, matrix
        left, top = a * x + c * y + e, b * x + d * y + f
    elif offset:
        left, top = left + offset[0], top + offset[1]
    size = _numbers(_attr(o, "Size"), 1)
    return _Fragment(left, top, size[0] if size and size[0] > 0 else height, fonts.get(_attr(o, "Font"), ""), text)


def _ofd_level(font: str, size: float, text: str) -> int:
    """Level of a heading by its font and size, or 0."""
    numbered = re.match(r"[（(]?[一二三四五六七八九十百千]+[）).、：:]", text)
    if font in HEADING_FONTS:
        return 1 if size >= 10 else 2 if size >= 7 or size >= 5.5 and not numbered else 3 if size >= 5.5 else 0
    return 0 if len(text) < 6 else 2 if size >= 7 else 3 if size >= 5.5 and numbered else 0


def decode_ofd(content: bytes) -> list[Block]:
    """Fragments at one height are lines; lines that follow closely are a paragraph, unless the one before ends a sentence or this one is numbered or indented."""
    z = _zip(content)
    names = z.namelist()
    fonts = {_attr(f, "ID"): _attr(f, "FontName") for n in names if re.search(r"(?:Public|Document)Res\.xml$", n) for f in _xml(z.read(n)).iter() if _local(f) == "Font"}
    pages = sorted((n for n in names if re.search(r"Pages/Page_\d+/Content\.xml$", n)), key=lambda n: int(re.search(r"Page_(\d+)", n)[1]))
    out: list[Block] = []
    for name in pages:
        lines: list[list[_Fragment]] = []
        for f in sorted((f for o in _xml(z.read(name)).iter() if _local(o) == "TextObject" and (f := _ofd_fragment(o, fonts))), key=lambda f: (f.y, f.x)):
            if lines and abs(f.y - lines[-1][-1].y) < 0.7 * min(f.size, lines[-1][-1].size):
                lines[-1].append(f)
            else:
                lines.append([f])
        group: list[list[_Fragment]] = []
        for line in [*lines, None]:
            if line is None or group and _ofd_new(group[-1], line):
                text = "".join(f.text for x in group for f in sorted(x, key=lambda f: f.x)).strip()
                if text:
                    level = _ofd_level(group[0][0].font, group[0][0].size, text)
                    out.append(Block("h" if level else "p", level, text))
                group = []
            if line is not None:
                group.append(line)
    return out


def _ofd_new(before: list[_Fragment], line: list[_Fragment]) -> bool:
    """Whether a line begins a paragraph."""
    gap, size = abs(line[0].y - before[0].y), (before[0].size + line[0].size) / 2
    if gap > max(2.2 * size, 4.0):
        return True
    indented = abs(min(f.x for f in line) - min(f.x for f in before)) > 1.5 * size
    if gap <= 1.8 * size and not indented:
        return False
    last, first = ("".join(f.text for f in sorted(x, key=lambda f: f.x)) for x in (before, line))
    starts = r"\s*(?:[（(]?[一二三四五六七八九十百千\d]+[）).、：:\s]|第[一二三四五六七八九十\d]+[章节条部分篇])"
    return indented or last.rstrip().endswith(("。", "；", "！", "？", ".", ";", "）", ")")) or re.match(starts, first) is not None


def collapse_quoted(text: str) -> tuple[str, str]:
    """(text up to the first mark of a quoted reply, a note with the start of the rest), or (text, "") where the rest is short."""
    cuts = [m.start() for m in (re.search(p, text, re.M) for p in QUOTE_MARKS) if m]
    if not cuts or len(text) - min(cuts) <= FOLD_KEEP * 1.5:
        return text, ""
    tail = text[min(cuts) :]
    preview = re.sub(r"\n{3,}", "\n\n", tail.strip())[:FOLD_KEEP]
    return text[: min(cuts)].rstrip(), f"引用历史已折叠：原文共 {len(tail)} 字符（回复链/转发历史），下方仅保留前 {min(FOLD_KEEP, len(tail))} 字符预览，避免同一制度重复入库。\n\n{preview}"


def _size_text(n: int) -> str:
    return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB"


def _is_attached(part) -> bool:
    kind, shown = part.get_content_type(), part.get_content_disposition()
    if part.is_multipart() or kind.startswith("message/"):
        return False
    return (shown == "attachment" or bool(part.get_filename())) and not (kind.startswith("image/") and (shown == "inline" or part.get("Content-ID")))


def _mail_body(parts: list) -> str:
    """Plain text of 20 characters or more without html; else html if it is longer than plain; else plain. Inline images are named."""
    texts = {"text/plain": [], "text/html": []}
    for p in parts:
        if p.get_content_type() in texts and not p.get_filename() and p.get_content_disposition() != "attachment":
            texts[p.get_content_type()].append(_mail_text(p))
    plain, web = ("\n".join(texts[k]).strip() for k in ("text/plain", "text/html"))
    if len(plain) >= 20 and not web or not web:
        return re.sub(r"\r\n?", "\n", plain)
    names = {(p.get("Content-ID") or "").strip(" <>"): p.get_filename() or "" for p in parts}
    shown = re.sub(r"""<img\b[^>]*src\s*=\s*["']cid:([^"']+)["'][^>]*>""", lambda m: f"[内嵌图片: {names.get(m[1].strip('<>')) or m[1]}]", web, flags=re.I)
    body = "\n\n".join(("> " if b.kind == "quote" else "") + b.text for b in decode_html(shown.encode("utf-8", "replace")) if b.text)
    return body if len(body) > len(plain) else re.sub(r"\r\n?", "\n", plain)


def decode_eml(content: bytes, depth: int = 0) -> list[Block]:
    """Header table with the attachments' names, body with long quotations folded, nested mails to a depth, attachments within budgets."""
    return _mail_blocks(message_from_bytes(content, policy=policy.default), depth)


def _mail_blocks(mail, depth: int) -> list[Block]:
    nested, parts, queue = [], [], [mail]
    while queue:  # parts of nested mails are theirs
        part = queue.pop(0)
        if part.get_content_type() == "message/rfc822" and part is not mail:
            nested += part.get_payload() if isinstance(part.get_payload(), list) else []
        elif part.get_content_type() == "message/delivery-status":
            continue
        elif part.is_multipart():
            queue = [*part.iter_parts(), *queue] if hasattr(part, "iter_parts") else [*part.get_payload(), *queue]
        else:
            parts.append(part)
    attached = [(p.get_filename() or "unnamed", p) for p in parts if _is_attached(p)]
    data_of = {id(p): p.get_payload(decode=True) or b"" for _, p in attached}
    rows = [[k, str(mail.get(k, ""))] for k in ("From", "To", "Cc", "Date", "Subject") if mail.get(k)]
    if attached and rows:
        listed = "、".join(f"{n} ({_size_text(len(data_of[id(p)]))})" for n, p in attached[:8])
        rows.append(["附件", listed + (f" 等 {len(attached)} 个" if len(attached) > 8 else "")])
    out = [Block("h", 1, str(mail.get("Subject", "")) or "-"), Block("table", 0, "", [["Field", "Value"], *rows])] if rows else []
    body, note = collapse_quoted(_mail_body(parts))
    out += [Block("p", 0, body.strip())] if body.strip() else []
    out += [Block("quote", 0, note)] if note else []
    for k, one in enumerate(nested if depth < MAX_NESTED else [], 1):
        out += [Block("hr", 0, ""), Block("h", 2, f"内嵌邮件 {k}: {one.get('Subject', '') or '(无主题)'}"), *_mail_blocks(one, depth + 1)]
    used_bytes = used_chars = 0
    for k, (name, part) in enumerate(attached, 1):
        data = data_of[id(part)]
        over = "size" if len(data) > MAX_ATTACHED else "size of all attachments" if used_bytes + len(data) > MAX_ATTACHED_ALL else "characters" if used_chars >= MAX_MAIL_CHARS else ""
        if over:
            out.append(Block("quote", 0, f"{name} ({_size_text(len(data))}) left out at the limit of {over}"))
            if over != "characters":
                continue
        used_bytes += len(data)
        if over or not data:
            continue
        out.append(Block("h", 3, f"附件 {k}/{len(attached)}: {name}（{_size_text(len(data))}）"))
        kind = sniff(data, name)
        try:
            blocks = decode(data, kind) if kind in DECODERS and kind not in ("eml", "msg") else [Block("p", 0, f"{len(data)} bytes")]
        except DecodeError as e:
            blocks = [Block("quote", 0, e.code)]
        kept, left = [], MAX_ATTACHED_CHARS
        for b in blocks:
            size = len(b.text) + sum(len(c) for r in b.rows or () for c in r)
            if size > left:
                kept += [b._replace(text=b.text[:left])] if b.rows is None and left > 0 else []
                kept.append(Block("quote", 0, "cut at the limit of characters"))
                left = 0
                break
            kept.append(b)
            left -= size
        used_chars += MAX_ATTACHED_CHARS - left
        out += kept
    return out


def decode_xls(content: bytes) -> list[Block]:
    out: list[Block] = []
    for name, rows in legacy.sheets(content)[:MAX_SHEETS]:
        kept, reason = limit_rows(iter(rows))
        out.append(Block("h", 1, name))
        if kept:
            width = max(map(len, kept))
            out.append(Block("table", 0, "", [r + [""] * (width - len(r)) for r in kept]))
        if reason:
            out.append(Block("quote", 0, f"cut at the limit of {reason}"))
    return out


def decode_doc(content: bytes) -> list[Block]:
    return [Block("table", 0, "", x) if kind == "table" else Block("p", 0, x) for kind, x in legacy.word_blocks(legacy.word_text(content))]


def decode_msg(content: bytes) -> list[Block]:
    mail = legacy.message(content)
    heads = [[k, v] for k, v in (("From", mail["from"]), ("To", mail["to"]), ("Subject", mail["subject"])) if v]
    out = [Block("h", 1, mail["subject"] or "-"), Block("table", 0, "", [["Field", "Value"], *heads]), *decode_text(mail["body"].encode())]
    for name, data in mail["attachments"]:
        out.append(Block("h", 2, name))
        kind = sniff(data, name)
        try:
            out += decode(data, kind) if kind not in ("eml", "msg") else []
        except DecodeError as e:
            out.append(Block("quote", 0, e.code))
    return out


def decode_pdf(content: bytes) -> list[Block]:
    """A paragraph a page; a file without text is for recognition elsewhere."""
    pages = legacy.pdf_pages(content)
    if not any(pages):
        raise DecodeError("needs_ocr", f"{len(pages)} pages")
    return [Block("p", 0, p) for p in pages if p]


def _mail_text(part) -> str:
    raw = part.get_payload(decode=True) or b""
    for encoding in (part.get_content_charset() or "utf-8", "utf-8", "gb18030"):
        try:
            return raw.decode(encoding)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace")


def repaired_name(info: zipfile.ZipInfo) -> str:
    """Names without the UTF-8 flag are read as cp437 by the library; they are most often GBK."""
    if info.flag_bits & 0x800 or info.filename.isascii():
        return info.filename
    try:
        return info.filename.encode("cp437").decode("gbk")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return info.filename


def entries(content: bytes, kind: str, name: str = "") -> Iterator[tuple[str, bytes]]:
    """Files of an archive, without those whose path leaves it; more than the budgets is an error."""
    found: Iterator[tuple[str, Callable[[], bytes], int]]
    if kind == "zip":
        z = _zip(content)
        found = ((repaired_name(i), lambda i=i: z.read(i), i.file_size) for i in z.infolist() if not i.is_dir())
    elif kind in ("gz", "bz2", "xz", "tar"):
        opened = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}.get(kind)
        try:
            plain = opened(io.BytesIO(content)).read(MAX_BYTES + 1) if opened else content
        except (OSError, EOFError, lzma.LZMAError) as e:
            raise DecodeError("malformed_document", str(e)) from e
        if len(plain) > MAX_BYTES:
            raise DecodeError("resource_limit", "bytes")
        try:
            t = tarfile.open(fileobj=io.BytesIO(plain))
            found = ((i.name, lambda i=i: t.extractfile(i).read(), i.size) for i in t if i.isfile())
        except tarfile.TarError:
            found = iter([(re.sub(r"\.(gz|bz2|xz)$", "", name) or "content", lambda: plain, len(plain))])
    else:
        raise DecodeError("unsupported_format", kind)
    total = 0
    for k, (path, read, size) in enumerate(found, 1):
        path = path.replace("\\", "/")
        total += size
        if k > MAX_ENTRIES or total > MAX_BYTES:
            raise DecodeError("resource_limit", "entries or bytes")
        if path.startswith("/") or re.match(r"[A-Za-z]:", path) or ".." in path.split("/"):
            continue
        yield path, read()


def sniff(content: bytes, name: str = "") -> str:
    """The kind of a file by its bytes, then by its name."""
    if content[:4] == b"PK\x03\x04":
        try:
            names = set(zipfile.ZipFile(io.BytesIO(content)).namelist())
        except zipfile.BadZipFile:
            return "zip"
        if "OFD.xml" in names or any(re.match(r"Doc_\d+/Document\.xml", n) for n in names):
            return "ofd"
        for test, kind in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx")):
            if test in names:
                return kind
        return "odt" if "content.xml" in names and "META-INF/manifest.xml" in names else "zip"
    if content.startswith(b"\xd0\xcf\x11\xe0"):
        return legacy.kind_of(content)
    for head, kind in ((b"%PDF-", "pdf"), (b"{\\rtf", "rtf"), (b"ITSF", "chm"), (b"\x1f\x8b", "gz"), (b"BZh", "bz2"), (b"\xfd7zXZ", "xz"), (b"Rar!", "rar"), (b"7z\xbc\xaf", "7z")):
        if content.startswith(head):
            return kind
    if content[257:262] == b"ustar":
        return "tar"
    low = content[:300].lstrip().lower()
    if low.startswith((b"<!doctype html", b"<html", b"<?xml")) and (b"<html" in low or b"doctype html" in low):
        return "html"
    if re.match(rb"(?:from|to|subject|date|received|return-path|delivered-to|mime-version|message-id): |from \S+@\S+ ", low):
        return "eml"
    ext = kind_by_name(name)
    return ext if ext in DECODERS else "bin" if b"\0" in content[:64] else "txt"


DECODERS: dict[str, Callable[[bytes], list[Block]]] = {
    "txt": decode_text, "md": decode_text, "csv": decode_csv, "html": decode_html, "rtf": decode_rtf, "docx": decode_docx,
    "xlsx": decode_xlsx, "pptx": decode_pptx, "odt": decode_odt, "ofd": decode_ofd, "eml": decode_eml,
    "xls": decode_xls, "doc": decode_doc, "msg": decode_msg, "pdf": decode_pdf,
}
ALIASES = {"htm": "html", "xhtml": "html", "wpsx": "docx", "dpsx": "pptx", "markdown": "md", "tgz": "gz", "tbz2": "bz2", "txz": "xz", "et": "xls", "etx": "xlsx", "wps": "doc"}
ARCHIVES = {"zip", "gz", "bz2", "xz", "tar"}
#: Formats that need a program or library that isn't here; they give a typed error.
EXTERNAL = {"chm": "unsupported_format", "ole": "unsupported_format", "ppt": "unsupported_format", "rar": "unsupported_format", "7z": "unsupported_format", "bin": "unsupported_format"}


def formats(spark: SparkSession) -> DataFrame:
    """name, extensions (sorted, with commas) and whether files of it can be read, of all kinds that are known."""
    names = [*DECODERS, *sorted(ARCHIVES), *(k for k in EXTERNAL if k not in ("ole", "bin"))]
    rows = [(n, e, n not in EXTERNAL) for n in names for e in [n, *(a for a, k in ALIASES.items() if k == n)]]
    known = spark.createDataFrame(rows, "name string, ext string, available boolean")
    return known.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("exts"), F.max("available").alias("available"))


def markdown_of(spark: SparkSession, path: str, max_bytes: int = 100 << 20) -> DataFrame:
    """path, markdown, error of one file (or of each in an archive); a file of more bytes is an error, and isn't read."""
    from inkwell.functions.render import document_markdown

    listed = spark.read.format("binaryFile").load(re.sub(r"([\\{}\[\]*?,^])", r"\\\1", path))
    large = listed.filter(F.col("length") > max_bytes).select("path", F.lit(None).cast("string").alias("markdown"), F.lit("resource_limit").alias("error"))
    made = decode_files(listed.filter(F.col("length") <= max_bytes)).select("path", document_markdown(F.col("blocks")).alias("markdown"), "error")
    return made.unionByName(large)


def toc(content: bytes) -> list[tuple[int, str, str]]:
    """(depth, title, local path) of the entries of a help book's table of contents, in order."""
    out: list[tuple[int, str, str]] = []
    depth, title, local = 0, "", ""
    for m in re.finditer(r"<(/?)(ul|object|param)\b([^>]*)>", text_of(content), re.I):
        tag = m[2].lower()
        if tag == "ul":
            depth = max(0, depth + (-1 if m[1] else 1))
        elif tag == "param":
            at = {k.lower(): v for k, v in re.findall(r"""(\w+)\s*=\s*["']([^"']*)["']""", m[3])}
            if at.get("name", "").lower() == "name":
                title = at.get("value", "")
            elif at.get("name", "").lower() == "local":
                local = at.get("value", "").replace("\\", "/")
        elif m[1] and (title or local):
            out.append((depth, title, local))
            title = local = ""
    return out


def kind_by_name(name: str) -> str:
    ext = name.rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""
    return ALIASES.get(ext, ext)


def decode(content: bytes, kind: str) -> list[Block]:
    if kind not in DECODERS:
        raise DecodeError(EXTERNAL.get(kind, "unsupported_format"), kind)
    try:
        return DECODERS[kind](content)
    except PermissionError as e:
        raise DecodeError("encrypted_document", str(e)) from e
    except (struct.error, IndexError, zlib.error) as e:
        raise DecodeError("malformed_document", f"{type(e).__name__}: {e}") from e


def decoded(content: bytes, name: str, depth: int = 0) -> Iterator[tuple[str, str, list[Block], str, str]]:
    """(path, kind, blocks, error code, detail) of a file, or of each file in an archive."""
    kind = sniff(content, name)
    try:
        if kind in ARCHIVES:
            if depth >= MAX_DEPTH:
                raise DecodeError("resource_limit", "depth")
            for path, data in entries(content, kind, name.rpartition("/")[2]):
                yield from decoded(data, f"{name}/{path}", depth + 1)
        else:
            second = kind_by_name(name)
            try:
                blocks = decode(content, kind)
            except DecodeError:
                if second == kind or second not in DECODERS:
                    raise
                kind, blocks = second, decode(content, second)  # the name knows better
            yield name, kind, blocks, "", ""
    except DecodeError as e:
        yield name, kind, [], e.code, str(e)
    except Exception as e:  # noqa: BLE001  a broken file is a row of the result
        yield name, kind, [], "conversion_error", f"{type(e).__name__}: {e}"[:300]


_BLOCK = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(_BLOCK), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["source", "path", "kind", "blocks", "error", "detail"])


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in ((p.as_py(), c.as_py()) for p, c in zip(batch.column(0), batch.column(1), strict=True)):
            rows, size = [], 0
            for p, k, blocks, code, detail in decoded(content or b"", path or ""):
                rows.append((path, p, k, [b._asdict() for b in blocks], code or None, detail or None))
                size += sum(len(b.text) + sum(len(c) for r in b.rows or () for c in r) for b in blocks)
                if size > BATCH_CHARS:  # the files of a large archive go on in parts
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)


def decode_files(files: DataFrame) -> DataFrame:
    """source, path, kind, blocks, error, detail of files (path, content); archives give a row a file in them."""
    bounded_batches(files.sparkSession)
    schema = "source string, path string, kind string, blocks array<struct<kind:string,level:int,text:string,rows:array<array<string>>>>, error string, detail string"
    return files.select(F.col("path"), F.col("content")).mapInArrow(_decode_batches, schema)
