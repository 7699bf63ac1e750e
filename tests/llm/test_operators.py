"""The ten operators against brute force on a small fixture, and on empty tables."""

import collections
import hashlib
import itertools

import numpy as np
import pytest

from inkwell.llm import decontamination, html_text, line_dedup, near, ngram_join, registry, sentence_piece, suffix_dedup
from inkwell.llm.near import components


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="session")
def docs(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == 0


def shingle_set(text):
    w = (text or "").split()
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def near_pairs(sets, threshold=0.8):
    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
            yield i, j


def roots(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        up[b] = a
    return [root(i) for i in range(n)]


def test_op1_counts_all_links(spark, small, docs):
    got = collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows(ngram_join.op1_ngram_join(spark, small)))
    sets = [shingle_set(t) for _, t in docs]
    pairs = list(near_pairs(sets))
    links = collections.Counter(x for p in pairs for x in p)
    top = roots(len(docs), pairs)
    low = {}
    for (d, _), r in zip(docs, top, strict=True):
        low[r] = min(low.get(r, -1 if d is None else d), -1 if d is None else d)
    want = collections.Counter((d, None if low[r] == -1 else low[r], links[i]) for i, ((d, _), r) in enumerate(zip(docs, top, strict=True)))
    assert got == want


def test_op1_keep_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids[100] == 0 and ids[201] == 0 and ids[20] == 1 and ids[500] == 1


def test_op2_equals_brute_force(spark, small, docs):
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(suffix_dedup.op2_suffix_dedup(spark, small)))
    want = suffix_dedup.brute_force([t for _, t in docs])
    assert got == collections.Counter((d, *w) for (d, _), w in zip(docs, want, strict=True))


def test_op2_passes_and_slices(monkeypatch):
    import random

    rng = random.Random(1)
    base = bytes(rng.choice(b"ab") for _ in range(900))
    texts = [base[i : i + 400] + bytes(rng.choice(b"abc") for _ in range(300)) for i in range(0, 400, 40)]
    monkeypatch.setattr(suffix_dedup, "SLICE", 500)
    found = collections.defaultdict(list)
    for flat, starts, ends, text_of, at in suffix_dedup._slices(texts):
        part, h, _, lo, n, a = suffix_dedup.contexts(flat, starts, ends)
        for p, key, s, k, x in zip(part, h, lo, n, a, strict=True):
            found[key].append((text_of[p], s - starts[p] + at[p], bytes(flat[s : s + k - 1 + 200]), x - s))
    gone = [set() for _ in texts]
    for members in found.values():
        hits = suffix_dedup.repeated_windows([(b, a) for _, _, b, a in members]) if len(members) > 1 else [[]]
        passes = [suffix_dedup.repeated_windows([(b, a) for _, _, b, a in members], k, k + 50) for k in range(0, 200, 50)] if len(members) > 1 else []
        for k, ((t, p, _, _), hit) in enumerate(zip(members, hits, strict=False)):
            if passes:
                assert (sum(x[k].astype(int) for x in passes) == hit).all()
            gone[t] |= {p + i for i, x in enumerate(hit) if x}
    count = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    assert gone == [{i for i in range(len(t) - 199) if count[t[i : i + 200]] > 1} for t in texts]


def test_op2_splits_hot_buckets(spark, monkeypatch):
    """A line in many surroundings, some of which repeat: the same result whether its bucket is split by the bytes next to it or not."""
    import random

    rng = random.Random(4)
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    line, around = word(17), [(word(20), word(20)) for _ in range(6)]
    texts = [f"{a} {line} {b}" for a, b in around] * 2 + [f"{word(20)} {line} {b}" for _, b in around[:3]] + [f"{a} {line} {word(20)}" for a, _ in around[3:]] + [f"{word(30)} {line} {word(30)}" for _ in range(20)]
    texts += [f"{around[0][0][-40:]} {line} {around[1][1][:60]}", line, f"{line} {around[2][1]}"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(suffix_dedup.brute_force(texts)))
    for limit in (suffix_dedup.HOT, 3):
        monkeypatch.setattr(suffix_dedup, "HOT", limit)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_substrings(frame).collect()} == want


def test_difference_cover():
    cover = set(suffix_dedup.difference_cover(32).tolist())
    assert all(any((i + d) % 32 in cover and (j + d) % 32 in cover for d in range(32)) for i in range(32) for j in range(32))


def test_op3_and_op9_scores(spark, small, docs):
    for name in ("op3_quality_classifier", "op9_toxicity"):
        got = rows(registry.queries()[name](spark, small))
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(d for d, _ in docs)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)


def test_op3_ignores_held_out_labels(spark, small):
    from pyspark.sql import functions as F

    from inkwell.llm import quality_classifier as q

    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    out = q.held_out(F.col("doc_id"), 3, 1)
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((str(r.doc_id), round(r.score, 9)) for r in q.score_documents(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_op4_matches_sql(spark, small):
    import duckdb

    from inkwell.llm import quality_rules as q

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet/*.parquet'")
    cur = con.execute(q.OP4_SQL)
    names = [c[0] for c in cur.description]
    want = collections.Counter(tuple(r) for r in cur.fetchall())
    got = collections.Counter(tuple(r[n] for n in names) for r in rows(q.op4_quality_rules(spark, small)))
    assert got == want


def test_op4_removes_frequent_lines(spark, small):
    from inkwell.llm import quality_rules as q

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = q.filter_documents(docs, min_docs=5)
    assert kept.columns == docs.columns
    mine = [r.text for r in kept.filter("doc_id between 300 and 311").collect()]
    assert all(t.count("\n") == 1 for t in mine)


def test_op5_equals_brute_force(spark, small, docs):
    ids = collections.Counter(d for d, _ in docs)
    own = [(d, t) for d, t in docs if d is not None and ids[d] == 1]
    frame = spark.createDataFrame(own, "doc_id long, text string")
    want = line_dedup.brute_force(own)
    got = {r["doc_id"]: r["text"] for r in rows(line_dedup.filter_documents(frame))}
    assert got == want and any(want[d] != t for d, t in own)


def test_op5_keeps_columns(spark, small, docs):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    out = line_dedup.filter_documents(frame)
    assert out.columns == frame.columns and out.count() == len(docs)


def test_op6_round_trip_and_parity(spark, small, docs):
    got = rows(sentence_piece.op6_sentence_piece(spark, small))
    assert len(got) == len(docs) and all(r["parity"] and r["round_trip"] for r in got)
    frame = spark.createDataFrame([(1, "héllo  wörld\n\x01 日本 🎉"), (2, None), (3, "")], "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in rows(sentence_piece.decode_documents(sentence_piece.encode_documents(frame)))}
    assert back == {1: "héllo  wörld\n\x01 日本 🎉", 2: "", 3: ""}


def test_op6_unigram_models():
    """A unigram model made of its protobuf fields: pieces by score, bytes for the rest."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, value):
        return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)

    pieces = [("<unk>", 0.0, 2), ("▁ab", -1.0, 1), ("▁a", -2.0, 1), ("b", -2.0, 1), ("▁", -3.0, 1), ("a", -3.0, 1)] + [(f"<0x{i:02X}>", -9.0, 6) for i in range(256)]
    data = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(3, 1) + field(4, 0))
    model = sentence_piece.parse_model(data)
    assert model["type"] == sentence_piece.UNIGRAM and model["byte_fallback"] and not model["squeeze"] and len(model["pieces"]) == 262
    made = sentence_piece.build_tokenizer(model)
    assert made.encode("ab ab", add_special_tokens=False).tokens == ["▁ab", "▁ab"]
    assert made.decode(made.encode("ab é", add_special_tokens=False).ids, skip_special_tokens=False) == "ab é"


def test_op7_pages(spark, small):
    got = {(r["page_id"], r["url"], r["text"]) for r in rows(html_text.op7_html_text(spark, small))}
    assert (20, "http://a.example/x", "T\none two é") in got and (21, None, "") in got and (22, "", "") in got
    assert (23, "x", "cut off") in got and (None, "http://a.example/y", "plain < text > here") in got
    assert all("Home" not in t and f"& {p}" in t for p, _, t in got if p is not None and p < 8)


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("<div class='header'>h</div><div id=content><p>a</p><div><p>b</div><div class='sidebar'>s</div></div><p>after", ["a", "b"]),
        ("<main><h1>t</h1><div class='post-content'>x<div>y</div></div><section class='related-posts'><p>r</section></main>", ["x", "y"]),
        ("<nav><a>open<article class=big><header><h2>T</h2></header>z<form><input>f</form><footer>by</footer></article>", ["T", "z"]),
        ("<article>a<br/>b<!-- c --><table><tr><td>1<td>2</table></article><article class='comment'>no</article>", ["a b", "1", "2"]),
        ("<article><p>x &lt;p&gt; &#233; &amp;amp;</p><div class='cookie-notice'>n</div><div hidden>h</div></article>", ["x <p> é &amp;"]),
    ],
)
def test_op7_marked_articles(page, blocks):
    assert html_text.blocks_of(page) == (blocks, True)


def test_op8_equals_brute_force(spark, small, docs):
    grams = lambda t: [tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(len(w) - 4)]
    items = [(r.item_id, grams(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = collections.Counter()
    for d, t in docs:
        g = grams(t)
        for i, it in items:
            n = len(it)
            best = 0
            for s in range(len(g) - n + 1 if n else 0):
                both = sum((collections.Counter(g[s : s + n]) & collections.Counter(it)).values())
                best = max(best, both / (2 * n - both))
            if best >= 0.8:
                want[d, i, round(best, 9)] += 1
    got = collections.Counter((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in rows(decontamination.op8_decontamination(spark, small)))
    assert got == want and want
    frame = spark.read.parquet(f"{small}/documents.parquet")
    kept = decontamination.drop_contaminated(frame, spark.read.parquet(f"{small}/benchmark.parquet"))
    assert kept.columns == frame.columns and kept.filter("doc_id BETWEEN 400 AND 402").count() == 0 and kept.count() == len(docs) - 3


def test_op8_fingerprints_match_python(spark):
    """SimHash against a loop over bits, and the distance of single blocks."""
    from pyspark.sql import functions as F

    values = [[5, -7, 1 << 62, -(1 << 63)], [1, 2, 3], [-1], [9, 9, 12]]
    marks = spark.createDataFrame([(v,) for v in values], "g array<long>").select(decontamination.simhash(F.col("g")).alias("m"), decontamination._simhash(F.col("g"), 32).alias("w")).collect()
    got = [r.m for r in marks]
    assert got == [r.w for r in marks]  # as counted in lanes for long items

    def loop(v):
        x = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in v) > len(v))
        return x - (1 << 64) if x >= 1 << 63 else x

    assert sorted(got) == sorted(map(loop, values))


def test_components_of_a_path_and_a_star(spark):
    path = [(i * 7919 % 1000, (i + 1) * 7919 % 1000) for i in range(50)]
    star = [(2000, 2000 + i) for i in range(1, 60)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(path + star + [(3, 3)], "a long, b long")).collect()}
    assert len({got[a] for a, _ in path}) == 1 and {got[b] for _, b in star} == {got[2000]}


def test_digest_of_removed_text():
    assert suffix_dedup.brute_force([None])[0] == (0, 0, 0, hashlib.sha256(b"").hexdigest())


def test_cells_let_every_pair_meet_once(spark):
    """Links counted over cells of three members equal those of one group."""
    from pyspark.sql import functions as F

    from inkwell.llm.near import dealt, verified

    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(0, 40, 3)] + [" ".join(words)] * 1
    members = spark.createDataFrame([(1, i, 1, t, len(t)) for i, t in enumerate(texts)], "comp long, rid long, weight long, body string, size long")
    small = dealt(members, "comp", cell=3)
    for sizes in ([2, 40, 3], [33, 1, 2]):  # groups that are compared together and one by one
        assert [len(x) for x in near._pairs(np.array(sizes))[1:]] == [sum(n * (n - 1) // 2 for n in sizes)] * 2
    assert small.agg(F.max("k")).first()[0] > 1
    got = {r.rid: r.texts for r in verified(small)[0].collect()}
    links = collections.Counter(x for p in near_pairs([shingle_set(t) for t in texts]) for x in p)
    assert got == dict(links)


def test_op4_removes_lines_of_a_host_of_any_size(spark, monkeypatch):
    """A line of more than MIN_DOCS texts goes on a small and on a large host, by either join; a document of such lines is rejected."""
    from inkwell.llm import quality_rules as q

    line = "read more about our terms of use on the page of terms and conditions that you have agreed to"
    rows = [(1000 * h + i, f"{line}\n" + " ".join(f"w{h}x{i}x{k}" for k in range(60)), f"h{h}") for h, n in ((0, 12), (1, 400), (2, 10)) for i in range(n)]
    rows += [(1990, "\n".join([line] * 4 + ["and a tail"]), "h1"), (2990, f"{line}\n" + " ".join(f"z{k}" for k in range(60)), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (q.SEND_ROWS, 0):
        monkeypatch.setattr(q, "SEND_ROWS", limit)
        got = {r["doc_id"]: r for r in q.score_documents(frame).collect()}
        assert {d // 1000 for d, r in got.items() if r["n_frequent_words"]} == {0, 1} and not got[2990]["n_frequent_words"]
        assert sum(1 for r in got.values() if r["n_frequent_words"]) == 12 + 401 and not got[1990]["kept"]
        left = {r.doc_id: r.text for r in q.filter_documents(frame).collect()}
        assert line not in left[1] and line not in left[1001] and line in left[2001] and 1990 not in left


def test_op4_limits_fire_on_the_given_tables(spark):
    """Lines above the limit are there in the tables of tests, so that the comparison with SQL covers the method."""
    from inkwell.llm import quality_rules as q

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert q.op4_quality_rules(spark, "/root/testdata/sf0.01").filter("n_frequent_words > 0").count() >= 10
    before, after = (x.selectExpr("sum(length(text))").first()[0] for x in (docs.join(q.filter_documents(docs).select("doc_id"), "doc_id", "left_semi"), q.filter_documents(docs)))
    assert after < before


def test_op6_checked_ids(spark, small, docs):
    got = rows(sentence_piece.encode_checked(spark.read.parquet(f"{small}/documents.parquet")))
    want = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in rows(sentence_piece.encode_documents(spark.read.parquet(f"{small}/documents.parquet"))))
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["n_ids"] == len(r["ids"]) and r["parity"] for r in got)


def test_intersections_of_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, n).astype(np.uint64)) for n in (5, 0, 30, 12, 1, 25)]
    _, a, b = near._pairs(np.array([4, 2]))
    assert near._common_of_pairs(sets, a, b).tolist() == [len(set(sets[x]) & set(sets[y])) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert near._common_of_pairs([], np.zeros(0, int), np.zeros(0, int)).tolist() == []
