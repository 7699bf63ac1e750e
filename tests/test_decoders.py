"""Formats, archives and their limits."""

import bz2
import gzip
import io
import tarfile
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.plans.format_plans import pack
from inkwell.sources import decoders as d

WORDS = ["alpha & beta", "日本語 <x>", "naïve \\ {y}"]


@pytest.mark.parametrize("kind", ["docx", "pptx", "odt", "ofd", "rtf", "txt"])
def test_words_come_back(kind):
    data = pack(kind, WORDS)
    assert d.sniff(data, f"a.{kind}") == kind
    assert [x for b in d.decode(data, kind) if b.kind != "h" for x in b.text.split("\n")] == WORDS


def test_sheet_budgets():
    rows = ([str(i)] * 3 for i in range(5000))
    kept, reason = d.limit_rows(rows)
    assert len(kept) == d.MAX_ROWS and reason == "rows"
    kept, reason = d.limit_rows(iter([["x" * 130_000], ["y"]]))
    assert len(kept) == 1 and reason == "characters"
    kept, reason = d.limit_rows(iter([["x"] * 100]))
    assert len(kept[0]) == d.MAX_COLUMNS and reason == "columns"
    assert d.limit_rows(iter([["", ""], []])) == ([], "")


def test_csv_pads_rows():
    assert d.decode_csv(b'a,"b ""c""",d\r\n1\r\n')[0].rows == [["a", 'b "c"', "d"], ["1", "", ""]]
    assert d.decode_csv(b"") == []


def test_html():
    blocks = d.decode_html(b"<!doctype html><![if !x]><h2>T &amp; u</h2><script>x</script><p>a <a href='l'>b</a><img src='i.png' alt='q'><ol><li>one<li>two</ol><table><tr><th>h<td></table><blockquote><p>q</blockquote>")
    assert blocks == [d.Block("h", 2, "T & u"), d.Block("p", 0, "a [b](l)![q](i.png)"), d.Block("li", 0, "1. one"), d.Block("li", 0, "2. two"), d.Block("table", 0, "", [["h", ""]]), d.Block("quote", 0, "q")]


def test_docx_lists_headings_tables():
    body = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t>1. numbered</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
    assert d.decode_docx(out.getvalue()) == [d.Block("h", 2, "H"), d.Block("li", 0, "item"), d.Block("p", 0, "1. numbered"), d.Block("table", 0, "", [["a", ""]])]


def test_mail_with_attachment_and_nested_mail():
    from email.message import EmailMessage

    inner = EmailMessage()
    inner["Subject"], inner["From"] = "in", "x@example.com"
    inner.set_content("the inner mail's text is here")
    mail = EmailMessage()
    mail["Subject"], mail["From"] = "Überschrift", "a@example.com"
    mail.set_content("short")
    mail.add_alternative("<p>the <b>longer</b> html body</p>", subtype="html")
    mail.add_attachment("x,y\n1,2\n".encode(), maintype="text", subtype="csv", filename="t.csv")
    mail.add_attachment(inner)
    texts = [b.text for b in d.decode_eml(mail.as_bytes())]
    assert texts[0] == "Überschrift" and "the **longer** html body" in texts and any(t.startswith("附件 1/1: t.csv") for t in texts) and "the inner mail's text is here" in texts


def test_archives():
    inner = pack("zip", WORDS)
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in (("in.zip", inner), ("/abs.txt", b"no"), ("x/y.txt", b"yes")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    found = list(d.decoded(gzip.compress(out.getvalue()), "a.tgz"))
    assert [(p, k, e) for p, k, _, e, _ in found] == [("a.tgz/in.zip/d/a.txt", "txt", ""), ("a.tgz/in.zip/b.docx", "docx", "malformed_document"), ("a.tgz/x/y.txt", "txt", "")]
    assert [p for p, *_ in d.decoded(bz2.compress(b"plain"), "n.txt.bz2")] == ["n.txt.bz2/n.txt"]
    deep = b"x"
    for _ in range(5):
        o = io.BytesIO()
        with zipfile.ZipFile(o, "w") as z:
            z.writestr("n.zip", deep)
        deep = o.getvalue()
    assert [e for *_, e, _ in d.decoded(deep, "n.zip")] == ["resource_limit"]


def test_gbk_names():
    info = zipfile.ZipInfo("中文.txt".encode("gbk").decode("cp437"))
    assert d.repaired_name(info) == "中文.txt"


def test_typed_errors():
    codes = {n: [e for *_, e, _ in d.decoded(data, n)][0] for n, data in (("a.pdf", b"%PDF-1"), ("b.bin", b"\0\1"), ("c.docx", b"PK\x03\x04junk"), ("e.rar", b"Rar!\x1a\x07"))}
    assert codes == {"a.pdf": "needs_ocr", "b.bin": "unsupported_format", "c.docx": "malformed_document", "e.rar": "unsupported_format"}


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300), st.sampled_from(["a.txt", "a.html", "a.rtf", "a.eml", "a.csv", "a"]))
def test_any_bytes_give_a_row(data, name):
    assert list(d.decoded(data, name))


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cc", "Cs", "Zl", "Zp", "Zs"]), min_size=1, max_size=40))
def test_rtf_round_trip(text):
    assert [b.text for b in d.decode_rtf(pack("rtf", [text]))] == [text.strip()]


def test_toc():
    hhc = b"""<UL><LI><OBJECT type="text/sitemap"><param name="Name" value="One"><param name="Local" value="a\\b.htm"></OBJECT>
    <UL><LI><OBJECT><param name="Name" value="Two"></OBJECT></UL></UL>"""
    assert d.toc(hhc) == [(1, "One", "a/b.htm"), (2, "Two", "")]


def test_second_candidate_by_name():
    assert [(k, e) for _, k, _, e, _ in d.decoded(b"Subject", "a.txt")] == [("txt", "")]
    assert [(k, e) for _, k, _, e, _ in d.decoded(b"%PDF-1.4 none", "a.txt")] == [("txt", "")]


def test_ofd_places_fonts_and_paragraphs():
    from inkwell.plans.format_plans import _zip_of

    def text(content, boundary, size=4, code="", font="1", matrix=""):
        return f'<TextObject Boundary="{boundary}" Size="{size}" Font="{font}"{matrix}><TextCode {code}>{content}</TextCode></TextObject>'

    page = (
        text("第一章", "10 5 80 12", 11, font="2")
        + text("world", "0 0 90 90", code='X="30" Y="30"') + text("hello ", "10 30 20 4")  # one line, in the order of the places
        + text("and the rest.", "10 37 60 4") + text("A new one", "10 44.5 60 4")  # 7 apart goes on; 7.5 after a full stop doesn't
        + text("moved", "0 0 1 1", code='X="5" Y="10"', matrix=' CTM="2 0 0 2 10 60"') + text("  ", "10 70 1 1")
    )
    fonts = '<Res><Fonts><Font ID="1" FontName="KaiTi"/><Font ID="2" FontName="黑体"/></Fonts></Res>'
    data = _zip_of({"OFD.xml": "<x/>", "Doc_0/PublicRes.xml": fonts, "Doc_0/Pages/Page_0/Content.xml": f"<Page>{page}</Page>"})
    assert [tuple(b[:3]) for b in d.decode_ofd(data)] == [("h", 1, "第一章"), ("p", 0, "helloworldand the rest."), ("p", 0, "A new one"), ("p", 0, "moved")]
