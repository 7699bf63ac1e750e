"""Compound and PDF files built here from the published structures."""

import struct
import zlib

import pytest

from inkwell.sources import decoders as d
from inkwell.sources import legacy

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


def compound(streams: dict[str, bytes]) -> bytes:
    """A version 3 file; all streams are padded beyond the mini stream's limit, a path's first part is a storage."""
    folders = sorted({p.split("/")[0] for p in streams if "/" in p})
    entries = [("Root Entry", 5, b"")] + [(f, 1, b"") for f in folders] + [(p.rpartition("/")[2], 2, data) for p, data in streams.items()]
    above = [""] + [""] * len(folders) + [p.split("/")[0] if "/" in p else "" for p in streams]
    fat, sectors, rows = [], [], []
    def add(data):
        if not data:
            return END
        first = len(sectors)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        sectors.extend(parts)
        fat.extend([first + k + 1 for k in range(len(parts) - 1)] + [END])
        return first
    for k, (name, kind, data) in enumerate(entries):
        start = add(data.ljust(4096, b"\0")) if kind == 2 else END
        children = [i for i in range(1, len(entries)) if above[i] == (name if kind == 1 else "") and (kind == 1 or i and kind == 5)]
        mates = [i for i in range(1, len(entries)) if above[i] == above[k]] if k else []
        right = next((i for i in mates if i > k), FREE) if k else FREE
        raw = name.encode("utf-16-le")
        rows.append(raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, FREE, right, children[0] if children and kind in (1, 5) else FREE) + b"\0" * 36 + struct.pack("<IQ", start, max(len(data), 4096) if kind == 2 else 0))
    directory = add(b"".join(rows))
    fat_at = len(sectors)
    fat.append(0xFFFFFFFD)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, directory, 0, 4096, END, 0, END, 0) + struct.pack("<I", fat_at) + b"\xff" * 432
    return head + b"".join(sectors) + table


def test_words():
    text = "First paragraph\rsecond é\ra\x07b\x07\x07c\x07d\x07\x07\rlast\r"
    doc = bytearray(3000)
    struct.pack_into("<H", doc, 10, 0x200)
    raw = text.encode("utf-16-le")
    struct.pack_into("<I", doc, 0x4C, len(text))
    doc[1024 : 1024 + len(raw)] = raw
    plc = struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 1024, 0)
    clx = b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", doc, 0x1A2, 0, len(clx))
    data = compound({"WordDocument": bytes(doc), "1Table": clx})
    assert d.sniff(data) == "doc"
    assert d.decode(data, "doc") == [d.Block("p", 0, "First paragraph"), d.Block("p", 0, "second é"), d.Block("table", 0, "", [["a", "b"], ["c", "d"]]), d.Block("p", 0, "last")]


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def test_sheets():
    sst = struct.pack("<II", 2, 2) + struct.pack("<HB", 3, 0) + b"one" + struct.pack("<HB", 2, 1) + "日本".encode("utf-16-le")
    xf = lambda f: record(0xE0, struct.pack("<HH", 0, f) + b"\0" * 16)
    cells = record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 2, 0, 1)) + record(0x203, struct.pack("<HHHd", 1, 0, 0, 2.5)) + record(0x203, struct.pack("<HHHd", 1, 1, 1, 45000.0)) + record(0xBD, struct.pack("<HHHIHIH", 2, 0, 0, (7 << 2) | 2, 0, (250 << 2) | 3, 1))
    sheet = record(0x809, b"\0" * 16) + cells + record(0x0A, b"")
    def book(offset):
        return record(0x809, b"\0" * 16) + record(0x85, struct.pack("<IHBB", offset, 0, 2, 0) + b"S1") + xf(0) + xf(14) + record(0xFC, sst) + record(0x0A, b"")
    data = compound({"Workbook": book(len(book(0))) + sheet})
    assert d.sniff(data, "a.et") == "xls"
    assert d.decode(data, "xls") == [d.Block("h", 1, "S1"), d.Block("table", 0, "", [["one", "", "日本"], ["2.5", "2023-03-15", ""], ["7", "2.5", ""]])]


def test_message():
    u = lambda t: t.encode("utf-16-le")
    mail = legacy.Compound(compound({"__properties_version1.0": b"x", "__substg1.0_0037001F": u("Subject"), "__attach_0/__substg1.0_3707001F": u("n.txt"), "__attach_0/__substg1.0_37010102": b"content"}))
    assert {"__properties_version1.0", "__attach_0/__substg1.0_37010102"} <= set(mail.paths)
    got = legacy.message(compound({"__properties_version1.0": b"x", "__substg1.0_0037001F": u("Subject"), "__attach_0/__substg1.0_3707001F": u("n.txt"), "__attach_0/__substg1.0_37010102": b"content"}))
    assert got["subject"].strip("\0") == "Subject" and got["attachments"][0][0].strip("\0") == "n.txt" and got["attachments"][0][1].startswith(b"content")


def pdf(pages, extra=b""):
    objects = {1: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))) + b"] >>"}
    for i, text in enumerate(pages):
        packed = zlib.compress(text)
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 1 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream"
    return b"%PDF-1.4\n" + extra + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in objects.items())


def test_pdf():
    data = pdf([rb"BT (Hello \(you\)) Tj 0 -12 Td [(wo) -20 (rld)] TJ ET", b"BT (page two) Tj ET"])
    assert d.decode(data, "pdf") == [d.Block("p", 0, "Hello (you)\nworld"), d.Block("p", 0, "page two")]
    for data, code in ((pdf([b"q Q"]), "needs_ocr"), (pdf([b""], b"trailer << /Encrypt 5 0 R >>"), "encrypted_document")):
        with pytest.raises(d.DecodeError) as e:
            d.decode(data, "pdf")
        assert e.value.code == code
