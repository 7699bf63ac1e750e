"""Compound files (doc, xls, msg) and simple PDF files, read from their published structures."""

from __future__ import annotations

import re
import struct
import zlib
from datetime import datetime, timedelta

END = 0xFFFFFFFE


class Compound:
    """Streams of an OLE2 compound file, by path."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(data) < 512:
            raise ValueError("no compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        n_fat, root, _, self.cutoff, mini_fat, _, difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
        sectors = list(struct.unpack_from("<109I", data, 76))
        for _ in range(n_difat):
            more = struct.unpack(f"<{self.size // 4}I", self._sector(difat))
            sectors += more[:-1]
            difat = more[-1]
        self.fat = [x for s in sectors[:n_fat] for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        self.mini = [x for s in self._chain(mini_fat, self.fat) for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        raw = b"".join(self._sector(s) for s in self._chain(root, self.fat))
        self.entries = [self._entry(raw[i : i + 128]) for i in range(0, len(raw) - 127, 128)]
        top = self.entries[0]
        self.ministream = b"".join(self._sector(s) for s in self._chain(top["start"], self.fat))
        self.paths: dict[str, dict] = {}
        self._walk(top["child"], "", set())

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size].ljust(self.size, b"\0")

    @staticmethod
    def _chain(start: int, table: list[int]) -> list[int]:
        out, seen = [], set()
        while start < END - 4 and start < len(table) and start not in seen:
            seen.add(start)
            out.append(start)
            start = table[start]
        return out

    @staticmethod
    def _entry(raw: bytes) -> dict:
        n = struct.unpack_from("<H", raw, 64)[0]
        left, right, child = struct.unpack_from("<III", raw, 68)
        start, size = struct.unpack_from("<IQ", raw, 116)
        return {"name": raw[: max(0, n - 2)].decode("utf-16-le", "replace"), "kind": raw[66], "left": left, "right": right, "child": child, "start": start, "size": size & 0xFFFFFFFF}

    def _walk(self, at: int, above: str, seen: set[int]) -> None:
        stack = [at]
        while stack:
            i = stack.pop()
            if i >= len(self.entries) or i in seen:
                continue
            seen.add(i)
            e = self.entries[i]
            self.paths[above + e["name"]] = e
            stack += [e["left"], e["right"]]
            if e["kind"] == 1:
                self._walk(e["child"], f"{above}{e['name']}/", seen)

    def read(self, path: str) -> bytes | None:
        e = self.paths.get(path)
        if e is None or e["kind"] != 2:
            return None
        if e["size"] < self.cutoff:
            parts = (self.ministream[s * self.mini_size : (s + 1) * self.mini_size] for s in self._chain(e["start"], self.mini))
        else:
            parts = (self._sector(s) for s in self._chain(e["start"], self.fat))
        return b"".join(parts)[: e["size"]]


def kind_of(data: bytes) -> str:
    """xls, doc, ppt, msg or ole, by the names of the streams."""
    try:
        names = set(Compound(data).paths)
    except (ValueError, struct.error):
        return "ole"
    for name, kind in (("Workbook", "xls"), ("Book", "xls"), ("WordDocument", "doc"), ("PowerPoint Document", "ppt"), ("__properties_version1.0", "msg")):
        if name in names:
            return kind
    return "ole"


def word_text(data: bytes) -> str:
    """The main text of a Word binary file, from its piece table; paragraphs end with \\r, cells with \\x07."""
    c = Compound(data)
    doc = c.read("WordDocument") or b""
    flags = struct.unpack_from("<H", doc, 10)[0]
    if flags & 0x100:
        raise PermissionError("encrypted")
    table = c.read("1Table" if flags & 0x200 else "0Table") or b""
    at, size = struct.unpack_from("<II", doc, 0x1A2)
    n_main = struct.unpack_from("<I", doc, 0x4C)[0]
    clx, i = table[at : at + size], 0
    while i < len(clx) and clx[i] == 1:
        i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
    if i >= len(clx) or clx[i] != 2:
        return ""
    plc = clx[i + 5 : i + 5 + struct.unpack_from("<I", clx, i + 1)[0]]
    n = (len(plc) - 4) // 12
    places = struct.unpack_from(f"<{n + 1}I", plc)
    out = []
    for k in range(n):
        fc = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * k + 2)[0]
        chars = places[k + 1] - places[k]
        if fc & 0x40000000:
            start = (fc & 0x3FFFFFFF) // 2
            out.append(doc[start : start + chars].decode("cp1252", "replace"))
        else:
            out.append(doc[fc : fc + 2 * chars].decode("utf-16-le", "replace"))
    return "".join(out)[: n_main or None]


def word_blocks(text: str) -> list[tuple[str, list[list[str]] | str]]:
    """("p", text) and ("table", rows): runs of cells and row ends of two rows and columns or more are tables.

    A paragraph mark ends a run: which marks lie inside a cell is known only from properties that aren't read.
    """
    text = re.sub(r"\x13[^\x14\x15]*\x14?|\x15", "", text)
    out: list = []
    for part in text.split("\r"):
        if "\x07" in part:
            rows = [r.split("\x07") for r in part.split("\x07\x07") if r.strip("\x07\r ")]
            rows = [[c.strip() for c in r] for r in rows]
            if len(rows) >= 2 and max(map(len, rows)) >= 2:
                out.append(("table", rows))
            else:
                out += [("p", c) for r in rows for c in r if c]
        elif clean := re.sub(r"[\x00-\x08\x0b-\x1f]", " ", part).strip():
            out.append(("p", clean))
    return out


def _number(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:g}" if abs(v) >= 1e15 else repr(round(v, 10))


def _date(v: float) -> str:
    t = datetime(1899, 12, 30) + timedelta(days=v)
    return t.strftime("%Y-%m-%d" if v == int(v) else "%Y-%m-%d %H:%M:%S")


def _rk(v: int) -> float:
    x = float(struct.unpack("<i", struct.pack("<I", v & 0xFFFFFFFC))[0] >> 2) if v & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", v & 0xFFFFFFFC))[0]
    return x / 100 if v & 1 else x


def _strings(parts: list[bytes]) -> list[str]:
    """The shared strings; one that goes on in a next record has its flags there again."""
    total = struct.unpack_from("<I", parts[0], 4)[0]
    k, i = 0, 8
    out = []
    while len(out) < total and k < len(parts):
        if i + 3 > len(parts[k]):
            k, i = k + 1, 0
            continue
        n, flags = struct.unpack_from("<HB", parts[k], i)
        i += 3
        runs = struct.unpack_from("<H", parts[k], i)[0] if flags & 8 else 0
        i += 2 if flags & 8 else 0
        extra = struct.unpack_from("<I", parts[k], i)[0] if flags & 4 else 0
        i += 4 if flags & 4 else 0
        text = ""
        wide = flags & 1
        while n:
            take = min(n, (len(parts[k]) - i) // (2 if wide else 1))
            raw = parts[k][i : i + take * (2 if wide else 1)]
            text += raw.decode("utf-16-le" if wide else "latin-1", "replace")
            i += len(raw)
            n -= take
            if n:
                k, i = k + 1, 1
                if k >= len(parts):
                    break
                wide = parts[k][0] & 1
        rest = 4 * runs + extra
        while k < len(parts) and rest > len(parts[k]) - i:
            rest -= len(parts[k]) - i
            k, i = k + 1, 0
        i += rest
        out.append(text)
    return out


def sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of the sheets of a BIFF8 workbook."""
    c = Compound(data)
    book = c.read("Workbook") or c.read("Book") or b""
    records, i = [], 0
    while i + 4 <= len(book):
        kind, n = struct.unpack_from("<HH", book, i)
        records.append((i, kind, book[i + 4 : i + 4 + n]))
        i += 4 + n
    names: list[tuple[int, str]] = []
    shared: list[str] = []
    formats: list[int] = []
    dated = set(range(14, 23)) | {45, 46, 47}
    for k, (_, kind, body) in enumerate(records):
        if kind == 0x2F:
            raise PermissionError("encrypted")
        if kind == 0x85:
            wide = body[7] & 1
            names.append((struct.unpack_from("<I", body)[0], body[8 : 8 + body[6] * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")))
        elif kind == 0xE0:
            formats.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == 0x41E and re.search(rb"[yd]", body[5:].lower().replace(b"[red]", b"")):
            dated.add(struct.unpack_from("<H", body)[0])
        elif kind == 0xFC:
            parts = [body]
            for _, more, b in records[k + 1 :]:
                if more != 0x3C:
                    break
                parts.append(b)
            shared = _strings(parts)

    def shown(v: float, xf: int) -> str:
        return _date(v) if xf < len(formats) and formats[xf] in dated and 0 < v < 2_900_000 else _number(v)

    out = []
    for start, name in names:
        cells: dict[tuple[int, int], str] = {}
        last, depth = (0, 0), 0
        for at, kind, body in records:
            if at < start:
                continue
            if kind == 0x809:
                depth += 1
            elif kind == 0x0A:
                depth -= 1
                if depth <= 0:
                    break
            elif kind in (0xFD, 0x203, 0x27E, 0x06, 0x204, 0x205) and len(body) >= 7:
                row, column, xf = struct.unpack_from("<HHH", body)
                last = (row, column)
                if kind == 0xFD:
                    s = struct.unpack_from("<I", body, 6)[0]
                    cells[last] = shared[s] if s < len(shared) else ""
                elif kind == 0x203:
                    cells[last] = shown(struct.unpack_from("<d", body, 6)[0], xf)
                elif kind == 0x27E:
                    cells[last] = shown(_rk(struct.unpack_from("<I", body, 6)[0]), xf)
                elif kind == 0x06 and body[12:14] != b"\xff\xff":
                    cells[last] = shown(struct.unpack_from("<d", body, 6)[0], xf)
                elif kind == 0x205:
                    cells[last] = "#" if body[7] else "TRUE" if body[6] else "FALSE"
                elif kind == 0x204:
                    n, wide = struct.unpack_from("<HB", body, 6)
                    cells[last] = body[9 : 9 + n * (1 + (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
            elif kind == 0x207:
                n, wide = struct.unpack_from("<HB", body)
                cells[last] = body[3 : 3 + n * (1 + (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1", "replace")
            elif kind == 0xBD:
                row, column = struct.unpack_from("<HH", body)
                for j in range((len(body) - 6) // 6):
                    xf, v = struct.unpack_from("<HI", body, 4 + 6 * j)
                    cells[row, column + j] = shown(_rk(v), xf)
        rows: dict[int, dict[int, str]] = {}
        for (r, col), v in cells.items():
            rows.setdefault(r, {})[col] = v
        out.append((name, [[row.get(j, "") for j in range(max(row) + 1)] for _, row in sorted(rows.items())]))
    return out


def message(data: bytes) -> dict:
    """subject, from, to, body and attachments (name, bytes) of an Outlook message."""
    c = Compound(data)

    def text(prefix: str, tag: str) -> str:
        raw = c.read(f"{prefix}__substg1.0_{tag}001F")
        if raw is not None:
            return raw.decode("utf-16-le", "replace").rstrip("\0")
        return (c.read(f"{prefix}__substg1.0_{tag}001E") or b"").decode("cp1252", "replace").rstrip("\0")

    folders = sorted({p.split("/")[0] for p in c.paths if p.startswith("__attach_")})
    attached = [(text(f"{f}/", "3707") or text(f"{f}/", "3704") or "unnamed", c.read(f"{f}/__substg1.0_37010102") or b"") for f in folders]
    return {"subject": text("", "0037"), "from": text("", "0C1A"), "to": text("", "0E04"), "body": text("", "1000"), "attachments": attached}


def _pdf_string(raw: bytes) -> bytes:
    escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else escapes.get(m[1], b"" if m[1][-1:] == b"\n" else m[1]), raw, flags=re.S)


def _pdf_map(cmap: bytes) -> dict[bytes, str]:
    out = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[bytes.fromhex(a.decode())] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, t in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first = int(a, 16)
            for k in range(first, min(int(b, 16), first + 65535) + 1):
                out[k.to_bytes(len(a) // 2, "big")] = "".join(map(chr, [*map(ord, text(t)[:-1]), ord(text(t)[-1]) + k - first]))
    return out


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page of a PDF file whose objects stand by themselves or in object streams; fonts by their ToUnicode maps, else Latin."""
    if re.search(rb"/Encrypt\s+\d+ \d+ R", data):
        raise PermissionError("encrypted")
    objects: dict[int, bytes] = {int(n): body for n, body in re.findall(rb"(?<!\d)(\d+) \d+ obj(.*?)endobj", data, re.S)}

    def stream(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        raw = m[1] if m else b""
        if b"FlateDecode" in body.split(b"stream")[0]:
            d = zlib.decompressobj()
            return d.decompress(raw, 200 << 20)
        return raw

    for body in list(objects.values()):
        if b"/ObjStm" in body.split(b"stream")[0]:
            plain = stream(body)
            first = int(re.search(rb"/First (\d+)", body)[1])
            heads = list(map(int, plain[:first].split()))
            for n, a, b in zip(heads[::2], heads[1::2], [*heads[3::2], len(plain) - first], strict=False):
                objects.setdefault(n, plain[first + a : first + b])
    ref = lambda name, body: [int(x) for x in re.findall(rb"(\d+) \d+ R", (re.search(rb"/" + name + rb"\s*(\[.*?\]|\d+ \d+ R)", body, re.S) or [b"", b""])[1])]
    codes: dict[bytes, str] = {}
    for body in objects.values():
        for n in ref(b"ToUnicode", body):
            codes |= _pdf_map(stream(objects.get(n, b"")))
    width = max(map(len, codes), default=1)

    def shown(raw: bytes) -> str:
        if not codes:
            return raw.decode("cp1252", "replace")
        parts = [raw[i : i + width] for i in range(0, len(raw), width)]
        return "".join(codes.get(p, p.decode("cp1252", "replace") if len(p) == 1 else "") for p in parts)

    ordered: list[int] = []

    def kids(n: int, depth: int = 0) -> None:
        body = objects.get(n, b"")
        if re.search(rb"/Type\s*/Pages", body) and depth < 50:
            for k in ref(b"Kids", body):
                kids(k, depth + 1)
        elif re.search(rb"/Type\s*/Page\b", body):
            ordered.append(n)

    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages", b) and b"/Parent" not in b]
    for n in roots:
        kids(n)
    out = []
    for n in ordered or [n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b", b)]:
        lines = [""]
        content = b"\n".join(stream(objects.get(k, b"")) for k in ref(b"Contents", objects[n]))
        for m in re.finditer(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]*)>|(-?\d*\.?\d+)\s+(?=[\(<\]\-\d])|\b(Td|TD|T\*|Tm|ET)|(')", content, re.S):
            if m[1] is not None:
                lines[-1] += shown(_pdf_string(m[1]))
            elif m[2] is not None:
                lines[-1] += shown(bytes.fromhex(re.sub(rb"\s", b"", m[2]).decode().ljust(2, "0"))) if len(re.sub(rb"\s", b"", m[2])) % 2 == 0 else ""
            elif (m[4] or m[5]) and lines[-1]:
                lines.append("")
        out.append("\n".join(x.strip() for x in lines if x.strip()))
    return out
