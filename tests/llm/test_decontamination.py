"""Operator 8 against brute force over all windows: items cut off at an end of the document, moved about, with repeated words; its SQL; its blocks."""

import collections
import random

from inkwell.llm import decontamination


def grams(text):
    w = text.lower().split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def best(text, item):
    g, it = grams(text), grams(item)
    n, found = len(it), 0
    for s in range(len(g) - n + 1):
        both = sum((collections.Counter(g[s : s + n]) & collections.Counter(it)).values())
        found = max(found, both / (2 * n - both))
    return found


def test_items_cut_at_the_ends_of_a_document(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items = {0: words(50), 1: words(15)}
    docs = {}
    for i, w in items.items():
        for cut in (1, 3, 6):
            docs[100 * i + cut] = " ".join(w[cut:] + words(30))
            docs[100 * i + 10 + cut] = " ".join(words(30) + w[:-cut])
        docs[100 * i + 50] = " ".join(w[1:])  # shorter than the item
    want = {(d, i): round(s, 9) for d, t in docs.items() for i, w in items.items() if (s := best(t, " ".join(w))) >= 0.8}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    held = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontamination.find_items(frame, held).collect()}
    assert got == want and {(1, 0), (3, 0), (11, 0), (13, 0), (101, 1), (111, 1)} <= want.keys()


def test_four_ways_to_hold_an_item(spark):
    """Without its first word at the start of a text, without its last at the end, its halves swapped, and whole."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    item, loop = words(40), (words(4) * 9)[:33]
    docs = {1: item[1:] + words(30), 2: words(30) + item[:-1], 3: words(15) + item[20:] + item[:20] + words(15), 4: words(9) + item + words(9)}
    docs |= {5: words(9) + loop + words(20), 6: words(3) + loop[:20] + words(1) + loop[20:], 7: words(50), 8: item[:20] + words(30), 9: loop * 4}
    texts = {0: " ".join(item), 1: " ".join(loop)}
    want = {(d, i): round(s, 9) for d, t in docs.items() for i, w in texts.items() if (s := best(" ".join(t), w)) >= 0.8}
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string")
    held = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    for send in (decontamination.SEND_BYTES, 0):
        decontamination.SEND_BYTES, before = send, decontamination.SEND_BYTES
        try:
            got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontamination.find_items(frame, held).collect()}
        finally:
            decontamination.SEND_BYTES = before
        assert got == want and {(1, 0), (2, 0), (3, 0), (4, 0), (5, 1)} <= want.keys()


def test_sql_over_all_windows(spark, small):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet/*.parquet'")
    cur = con.execute(decontamination.OP8_SQL)
    names = [c[0] for c in cur.description]
    want = collections.Counter(cur.fetchall())
    got = collections.Counter(tuple(r[n] for n in names) for r in decontamination.op8_decontamination(spark, small).collect())
    assert got == want and want


def test_blocks_meet_within_the_radius(spark):
    """Any two fingerprints within RADIUS agree in a block with one of its probes."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontamination.RADIUS):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (a, b)))
    frame = spark.createDataFrame(rows, "a long, b long")
    blocks, radius = decontamination.BLOCKS, decontamination.RADIUS
    both = frame.select(F.size(F.array_intersect(decontamination._blocks(F.col("a"), blocks), decontamination._probes(F.col("b"), blocks, radius))).alias("n"))
    assert both.filter("n = 0").count() == 0
