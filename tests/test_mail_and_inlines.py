"""Mail rules, inline marks, links and images, the plug-in surface."""

import base64
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from inkwell.functions import config
from inkwell.operators import refs, sinks
from inkwell.plugin import register
from inkwell.sources import decoders
from inkwell.sources.decoders import decode_docx, decode_eml, decode_html


def mail(subject="S", body="", **heads):
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = subject, "a@example.com", "b@example.com"
    m.set_content(body)
    return m


def text_of(blocks):
    return "\n".join(b.text + " ".join(c for r in b.rows or () for c in r) for b in blocks)


def test_manifest_and_attachments():
    m = mail(body="see the attachments of this mail")
    for i in range(10):
        m.add_attachment(f"inside {i}".encode(), maintype="text", subtype="plain", filename=f"f{i}.txt")
    out = decode_eml(m.as_bytes())
    row = next(r for b in out if b.rows for r in b.rows if r[0] == "附件")
    assert "f0.txt (8 B)" in row[1] and "f7.txt" in row[1] and "f8.txt" not in row[1] and row[1].endswith("等 10 个")
    assert all(f"inside {i}" in text_of(out) for i in range(10))


def test_budgets_of_attachments(monkeypatch):
    for name, value in (("MAX_ATTACHED", 100), ("MAX_ATTACHED_ALL", 150), ("MAX_ATTACHED_CHARS", 40), ("MAX_MAIL_CHARS", 60)):
        monkeypatch.setattr(decoders, name, value)
    m = mail(body="a body that is long enough for a mail")
    for name, n in (("large", 101), ("one", 90), ("over", 80), ("two", 30), ("late", 5)):
        m.add_attachment(name.encode() * (n // len(name)) + b"." * (n % len(name)), maintype="text", subtype="plain", filename=f"{name}.txt")
    out = decode_eml(m.as_bytes())
    notes = [b.text for b in out if b.kind == "quote"]
    assert [n.split(" ")[0] for n in notes] == ["large.txt", "cut", "over.txt", "late.txt"]
    assert notes[0].endswith("of size") and notes[2].endswith("of all attachments") and notes[3].endswith("of characters")
    assert "oneone" in text_of(out) and "twotwo" in text_of(out) and "overover" not in text_of(out)


@pytest.mark.parametrize(
    "mark",
    ["-----原始邮件-----", "---- Original Message ----", "--forwarded message--", "____________", "On Monday x wrote:", "发件人: x\n发送时间: y", "在 2024年1月2日 x 写道：", "--邮件原件--", "> *-- ORIGINAL MESSAGE --"],
)
def test_long_quotations_are_folded(mark):
    out = decode_eml(mail(body=f"new text of this mail\n\n{mark}\n" + "history " * 200).as_bytes())
    assert "new text" in text_of(out) and "引用历史已折叠" in text_of(out) and len(text_of(out)) < 900
    short = decode_eml(mail(body=f"new text of this mail\n\n{mark}\nhistory").as_bytes())
    assert "折叠" not in text_of(short) and "history" in text_of(short)


def test_html_body_names_inline_images_and_folds():
    m = mail(body="short")
    m.add_alternative(f"<p>the body</p><img src='cid:i1@x'><blockquote>-----原始邮件-----<br>{'old ' * 300}</blockquote>", subtype="html")
    m.get_payload()[1].add_related(b"\x89PNG", maintype="image", subtype="png", cid="<i1@x>", filename="pic.png")
    out = text_of(decode_eml(m.as_bytes()))
    assert "the body" in out and "[内嵌图片: pic.png]" in out and "cid:" not in out and "折叠" in out and "附件" not in out


def test_nested_mails_have_a_depth():
    inner = mail("inner", "the text of the inner mail")
    inner.add_attachment(b"deep", maintype="text", subtype="plain", filename="deep.txt")
    middle = mail("middle", "the text of the middle mail")
    middle.add_attachment(inner)
    outer = mail("outer", "the text of the outer mail")
    outer.add_attachment(middle)
    out = text_of(decode_eml(outer.as_bytes()))
    assert "outer mail" in out and "内嵌邮件 1: middle" in out and "middle mail" in out and "inner mail" not in out


def test_inline_marks_of_html_and_docx():
    from inkwell.plans.format_plans import _zip_of

    page = "<p>a <b>bold </b>and <em>it</em> <del>old</del> <code>x</code> <a href='u'><strong>l</strong></a><b> </b></p><hr><pre>a\n  b</pre><p>c <b>open"
    assert [tuple(b[:3]) for b in decode_html(page.encode())] == [("p", 0, "a **bold** and *it* ~~old~~ `x` [**l**](u)"), ("hr", 0, ""), ("code", 0, "a\n  b"), ("p", 0, "c **open**")]
    run = lambda text, props="": f"<w:r><w:rPr>{props}</w:rPr><w:t>{text}</w:t></w:r>"
    body = f"<w:p>{run('plain ')}{run('bo', '<w:b/>')}{run('ld ', '<w:b/>')}{run('both', '<w:b/><w:i/>')}{run('off', '<w:b w:val=\"0\"/>')}</w:p><w:p><w:pPr><w:numPr><w:ilvl w:val=\"1\"/><w:numId w:val=\"2\"/></w:numPr></w:pPr>{run('item', '<w:strike/>')}</w:p>"
    data = _zip_of({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'})
    assert [tuple(b[:3]) for b in decode_docx(data)] == [("p", 0, "plain **bold** ***both***off"), ("li", 1, "~~item~~")]


def test_paths_of_references(spark):
    rows = [("d/e/a.md", r, w) for r, w in (("x.png", "d/e/x.png"), ("../x.png", "d/x.png"), ("./../../y/./z%20a.png?q#f", "y/z a.png"), ("../../../x.png", "../x.png"), ("http://h/x.png", None), ("/x.png", None), ("#top", None), ("data:x", None), ("a\\b.png", "d/e/a/b.png"))]
    df = spark.createDataFrame(rows, "rel string, ref string, want string")
    assert [(r.ref, r.got) for r in df.select("ref", "want", refs.resolved(F.col("rel"), F.col("ref")).alias("got")).collect()] == [(r, w) for _, r, w in rows]
    pairs = [("a/b/c.md", "a/x.md", "../x.md"), ("a/b.md", "a/c.md", "c.md"), ("a.md", "b/c.md", "b/c.md"), ("a/b/c.md", "d.md", "../../d.md"), ("a/b.md", "a/b/c.md", "b/c.md")]
    df = spark.createDataFrame(pairs, "rel string, target string, want string")
    assert all(r.got == r.want for r in df.select("want", refs.relative_to(F.col("target"), F.col("rel")).alias("got")).collect())


def test_images_and_their_copies(spark, tmp_path):
    docs = spark.createDataFrame([("d/a.md", "![x](i.png) and ![y](no.png)\n![z](i.png)"), ("b.md", "no image"), ("c.md", None), ("n.md", "![q](http://h/x.png)")], "rel string, markdown string")
    files = spark.createDataFrame([("d/i.png", 3, b"abc")], "path string, size long, content binary")
    got = {r.rel: r.markdown for r in refs.place_images(docs, files).collect()}
    assert got == {"d/a.md": "![x](a.files/i.png) and （原图缺失：no.png）\n![z](a.files/i.png)", "b.md": "no image", "c.md": None, "n.md": "（原图缺失：x.png）"}
    data = {r.rel: r.markdown for r in refs.place_images(docs, files, "base64", placeholder=False).collect()}
    inline = f"data:image/png;base64,{base64.b64encode(b'abc').decode()}"
    assert data["d/a.md"] == f"![x]({inline}) and ![y](no.png)\n![z]({inline})"
    assert refs.place_images(docs, files, "none") is docs
    refs_of = refs.image_references(docs, files)
    plan = refs_of.filter("verdict = 'linked'").join(files.select("path", "content"), "path").select(F.concat(refs.folder(F.col("rel")), F.lit("/"), "goal").alias("goal"), "content").distinct()
    assert [r.copied for r in sinks.copy_files(plan, str(tmp_path)).collect()] == [True]
    assert (tmp_path / "d" / "a.files" / "i.png").read_bytes() == b"abc"
    assert [r.copied for r in sinks.copy_files(plan, str(tmp_path)).collect()] == [False]


def test_plugin(spark):
    register(spark)
    spark.createDataFrame([("a.csv", b"x,y\n1,2\n"), ("b.pdf", b"%PDF-1.4"), ("c.txt", b"")], "path string, content binary").createOrReplaceTempView("plugged")
    got = {(r.path, r.kind, r.block, r.error) for r in spark.sql("SELECT d.* FROM plugged, LATERAL inkwell_decode(path, content) d").collect()}
    assert got == {("a.csv", "csv", "table", None), ("b.pdf", "pdf", None, "needs_ocr"), ("c.txt", "txt", None, None)}
    assert spark.sql(r"SELECT inkwell_newlines('a\r\nb\rc') AS t").first().t == "a\nb\nc"


def test_recognition_signature():
    base = {"backend": "local", "tile_size": 1, "threads": 4}
    assert len(config.recognition_signature(base)) == 12
    assert config.recognition_signature(base) == config.recognition_signature({**base, "threads": 8, "remote": {"url": "u"}})
    assert config.recognition_signature(base) != config.recognition_signature({**base, "tile_size": 2})
    remote = {**base, "backend": "remote"}
    assert config.recognition_signature({**remote, "remote": {"url": "u"}}) != config.recognition_signature({**remote, "remote": {"url": "v"}})


def test_dead_letters_and_retry(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "rel string, markdown string")

    def send(rel, text):
        if rel == "b":
            raise OSError("down")
        return "id"

    sent = sinks.deliver(rows, send, retries=2, delay=0.01)
    sinks.dead_letters(sent, str(tmp_path / "dead"))
    sinks.dead_letters(sent, str(tmp_path / "dead"))
    assert [(r.rel, r.attempts) for r in sent.orderBy("rel").collect()] == [("a", 1), ("b", 2)]
    assert [r.rel for r in sinks.retry(spark, str(tmp_path / "dead"), rows).collect()] == ["b"]
    scores = spark.createDataFrame([("t", "f", True, 1.0, 2.0, 3, "")], "ts string, file string, ok boolean, score double, seconds double, chars long, error string")
    sinks.append_scores(scores, str(tmp_path / "scores"))
    sinks.append_scores(scores, str(tmp_path / "scores"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "scores")).count() == 2
