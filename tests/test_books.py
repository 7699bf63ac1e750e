"""Unpacked help books: places, titles, void entries, pages that no entry names, links between pages."""

from inkwell.operators.books import placed, render_books, safe_name


def entry(name, local=""):
    return f'<li><object type="text/sitemap"><param name="Name" value="{name}"><param name="Local" value="{local}"></object>'


TOC = (
    "<ul>" + entry("01.规章", "a.htm") + "<ul>" + entry("银行") + "<ul>" + entry("办法", "d\\b.htm") + entry("关于废止的决定", "d/c.htm") + "</ul>" + entry("重名", "d/e.htm") + entry("重名", "d/f.htm") + "</ul>"
    + entry("25.已废止") + "<ul>" + entry("旧/办法", "old.htm") + "</ul>" + entry("空") + entry("页眉", "header.htm") + "</ul>"
)
PAGES = {"a.htm": "<h1>A</h1><p>to <a href='d/b.htm#x'>b</a>", "d/b.htm": "<p>text of b <a href='../a.htm'>a</a> <a href='http://x.example/'>x</a>", "d/c.htm": "<p>c", "d/e.htm": "<p>e", "d/f.htm": "", "old.htm": "<p>old", "header.htm": "<p>h", "lost.htm": "<p>lost <a href='d/e.htm'>e</a>", "z/lost.htm": "<p>again", "style.css": "p{}"}


def test_pages_of_a_book(spark):
    files = [("手册", p, t.encode()) for p, t in PAGES.items()] + [("手册", "x/y.hhc", b"<ul></ul>"), ("手册", "main.hhc", TOC.encode()), ("flat", "q.html", b"<p>q")]
    got = {r.rel: r for r in render_books(spark.createDataFrame(files, "book string, path string, content binary")).collect()}
    assert set(got) == {"手册/01.规章/01.规章.md", "手册/01.规章/银行/办法.md", "手册/01.规章/银行/关于废止的决定.md", "手册/01.规章/重名.md", "手册/01.规章/重名_2.md", "手册/25.已废止/旧_办法.md", "手册/_未编目/lost.md", "手册/_未编目/lost_2.md", "flat/q.md"}
    assert got["手册/25.已废止/旧_办法.md"].status == "已废止" and "本文档已废止" in got["手册/25.已废止/旧_办法.md"].markdown
    assert got["手册/01.规章/银行/关于废止的决定.md"].status == "现行有效"  # its own title doesn't make it void
    first = got["手册/01.规章/01.规章.md"].markdown
    assert first.startswith('---\ntitle: "01.规章"\n') and "to [b](银行/办法.md#x)" in first and first.count("# A") == 1
    assert "[a](../01.规章.md) [x](http://x.example/)" in got["手册/01.规章/银行/办法.md"].markdown and "# 办法" in got["手册/01.规章/银行/办法.md"].markdown
    assert "[e](../01.规章/重名.md)" in got["手册/_未编目/lost.md"].markdown and "内容为空" in got["手册/01.规章/重名_2.md"].markdown


def test_names_and_places():
    assert safe_name("a/b:c. ") == "a_b_c" and safe_name("") == "未命名" and len(safe_name("长" * 100).encode()) <= 180
    assert list(placed([])) == [] and [p[0] for p in placed([(1, "A", "a"), (1, "a", "b"), (3, "deep", "c")])] == ["A.md", "a_2/a_2.md", "a_2/deep.md"]
