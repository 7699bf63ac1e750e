import random

import pytest


def words(rng, n):
    return " ".join("".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ra", "so", "te"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """A folder of small tables with copies, near copies, shared passages, nulls, empty, blank and long texts, repeated rows and clashing columns."""
    rng = random.Random(5)
    top = str(tmp_path_factory.mktemp("small"))
    texts = ["\n".join(words(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 8))) for _ in range(40)]
    passage = words(rng, 60)
    item = words(rng, 30)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "de", "s0", 1) for i in range(5)]
    for i in range(6):
        w = texts[7].split(" ")
        w[3 * i + 2] = f"edit{i}"
        rows.append((200 + i, " ".join(w), "en", "s1", 1))
    rows += [(300 + i, f"{words(rng, 20)}\n{passage}\n{words(rng, 12)}", "en", "s0", 1) for i in range(12)]
    rows += [(400 + i, f"{words(rng, 15)} {item} {words(rng, 9)}", "en", "s2", 1) for i in range(3)]
    rows += [(450 + i, f"{words(rng, 90)} idiot{'' if i % 2 else 's'} {words(rng, 30)}", "en", "s2", 1) for i in range(20)]
    rows += [(470 + i, " ".join(["LOUD!!"] * 10 + [words(rng, 3).upper()] * 20), "en", "s2", 1) for i in range(10)]
    rows += [(500, None, None, None, None), (501, "", "en", None, 0), (502, " \n\t ", "en", "s0", 4), (503, "x", "en", "s0", 1), (None, texts[0], None, "s0", None), (None, None, None, None, None)]
    rows += [(504, "a" * 3000, "en", "s0", 3000), (505, words(rng, 30000), "en", "s0", 9), (506, "tail\x00 é 日本 �\r\nz", "en", "s0", 9)]
    rows += [(0, texts[0], "en", "s0", len(texts[0]))] * 2 + [(1, "another text with the id of a row " + words(rng, 40), "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {"_key": "k", "rid": "r", "band": "b", "h": "h", "at": "a", "_row": "w", "n": "n", "_gone": "g", "label.with dot": "d", "spans": "s", "y": "y", "first": "f", "_of": "o"}
    for name, value in clash.items():
        docs = docs.withColumn(name, __import__("pyspark").sql.functions.lit(value))
    docs.repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(r[0], 0 if (r[0] or 0) // 10 == 47 else 1, 1 if (r[0] or 0) in range(450, 470) else 0) for r in rows if r[0] is None or r[0] != 3] + [(5, None, None), (6, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(0, item), (1, words(rng, 25)), (2, None), (3, "two words"), (4, item), (None, words(rng, 20))], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    menu = "Home About Contact Imprint Search Login Help Terms Privacy now"
    pages = [(i, f"http://h{i % 2}.example/{i}", f"<html><body><div>{menu}</div><p>{words(rng, 30)} &amp; {i}</p></body></html>") for i in range(8)]
    pages += [(20, "http://a.example/x", "<nav>menu</nav><article><h1>T</h1><p>one<br>two&nbsp;&eacute;</p><div class='comments'><p>c</p></div><aside>s</aside></article><footer>f</footer>"), (21, None, None), (22, "", ""), (23, "x", "<p>cut <b>off"), (None, "http://a.example/y", "plain < text > here"), (20, "http://a.example/x", "<article><p>again</article>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    return top


@pytest.fixture(scope="session")
def empty(spark, small, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{top}/{name}.parquet")
    return top
