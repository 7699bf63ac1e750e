"""Operator 7 on pages without marks: runs that repeat on distinct pages, against brute force over all runs."""

import collections
import itertools
import random

from inkwell.llm import html_text as h

MENU = ["Home", "About us", "Contact", "Terms and conditions of use", "Privacy"]


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def common_runs(a, b):
    """Maximal runs of equal tokens of two lists: (start in a, tokens)."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        if a[i] == b[j]:
            table[i + 1][j + 1] = table[i][j] + 1
    return [(i - table[i][j], table[i][j]) for i in range(1, len(a) + 1) for j in range(1, len(b) + 1) if table[i][j] and (i == len(a) or j == len(b) or not table[i + 1][j + 1])]


def brute_force(pages):
    """What stays of each page (a tuple of blocks) of one host: all runs of two pages that are a block or have tokens enough."""
    kinds = sorted(set(pages))
    tokens = {b: b.split(" ") for x in kinds for b in x}
    holders = collections.defaultdict(set)
    for i, x in enumerate(kinds):
        for b in x:
            holders[b].add(i)
    out = []
    for i, x in enumerate(kinds):
        left = []
        for b in x:
            n, share, size = len(holders[b]), 1.0 if len(holders[b]) > 1 else 0.0, len(tokens[b])
            if not share:
                depth = h.DEPTHS[size >= h.LONG][0] + h.DEPTHS[size >= h.LONG][1] - 1
                covered, others = set(), set()
                for j, y in enumerate(kinds):
                    for c in y if j != i else ():
                        if (len(tokens[c]) >= h.LONG) == (size >= h.LONG):
                            for s, k in common_runs(tokens[b], tokens[c]):
                                if k >= depth:
                                    covered |= set(range(s, s + k))
                                    others.add(j)
                share, n = len(covered) / size, 1 + len(others)
            if not (share >= h.COVERED and n >= (3 if size >= h.QUOTED else 2)):
                left.append(b)
        out.append(left)
    return {x: y for x, y in zip(kinds, out, strict=True)}


def extract(spark, pages, hosts=("a.example",)):
    rows = [(i, f"http://{hosts[i % len(hosts)]}/{i}", "<html><body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body></html>") for i, blocks in enumerate(pages)]
    got = {r.page_id: r.text for r in h.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i].split("\n") if got[i] else [] for i in range(len(pages))]


def test_unmarked_pages_equal_brute_force(spark):
    """Menus of short blocks, a footer with a number in it, a long notice with a name in it, and texts."""
    rng = random.Random(7)
    footer, notice = words(rng, 45), words(rng, 120)
    pages = []
    for i in range(7):
        own = [" ".join(words(rng, n)) for n in (5, 40, 90)]
        pages.append((*MENU, *own, " ".join([*footer[:44], f"page{i}"]), " ".join([f"name{i}", *notice])))
    pages.append((*MENU[:2], " ".join(words(rng, 30))))
    pages.append(pages[0])
    want = brute_force([tuple(p) for p in pages])
    got = extract(spark, pages)
    assert got == [want[tuple(p)] for p in pages]
    assert got[0] == list(pages[0][5:8]) and got[7] == [pages[7][2]]


def test_quotations_and_copies_stay(spark):
    """A quotation of ten or sixty words on two pages, and a paragraph that two pages have alike; other hosts' pages don't count."""
    rng = random.Random(8)
    short, long, same = words(rng, 10), words(rng, 60), " ".join(words(rng, 50))
    pages = [[" ".join(words(rng, 20) + short + words(rng, 30))] for _ in range(2)]
    pages += [[" ".join(words(rng, 70) + long + words(rng, 80))] for _ in range(2)]
    pages += [[same, " ".join(words(rng, 25))] for _ in range(2)]
    assert extract(spark, pages) == pages
    menus = [[*MENU, " ".join(words(rng, 30))] for _ in range(2)]
    assert extract(spark, menus, ("a.example", "b.example")) == menus
    assert extract(spark, menus) == [[m[-1]] for m in menus]


def test_marked_articles_lose_only_what_the_host_repeats(spark):
    """A line on half of a host's pages goes from marked articles; one on two of them, and an article that is a copy, stay."""
    rng = random.Random(9)
    advert, twice = " ".join(words(rng, 12)), " ".join(words(rng, 12))
    bodies = [[" ".join(words(rng, 60)), *([advert] if i < 7 else []), *([twice] if i in (1, 2) else []), " ".join(words(rng, 40))] for i in range(12)]
    bodies += [[*bodies[0][:2]], [*bodies[0][:2], "another end"]]
    rows = [(i, f"http://a.example/{i}", "<div>menu</div><article>" + "".join(f"<p>{b}</p>" for b in x) + "</article>") for i, x in enumerate(bodies)]
    got = {r.page_id: r.text.split("\n") for r in h.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(14)] == [[b for b in x if b != advert] for x in bodies]
    few = [r for r in rows if r[0] > 4]
    got = {r.page_id: r.text.split("\n") for r in h.extract_pages(spark.createDataFrame(few, "page_id long, url string, html string")).collect()}
    assert all(got[i] == bodies[i] for i in range(5, 14))


def test_hot_buckets_are_cut_in_cells(spark, monkeypatch):
    monkeypatch.setattr(h, "CELL", 3)
    rng = random.Random(10)
    footer = words(rng, 45)
    pages = [[" ".join(words(rng, 33)), " ".join([*footer[:44], f"page{i}"])] for i in range(12)]
    assert extract(spark, pages) == [[x] for x, _ in pages]


def test_very_long_and_odd_pages(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "http://a.example/1", f"<p>{long}"), (2, "http://a.example/2", f"<p>{long}<p>more text"), (3, None, None), (4, "http://a.example/4", ""), (5, "", "<p></p>"), (1, "http://a.example/1", f"<p>{long}")]
    got = collections.Counter((r.page_id, r.n_chars) for r in h.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == {(1, len(long)): 2, (2, len(long) + 10): 1, (3, 0): 1, (4, 0): 1, (5, 0): 1}


def test_runs_anywhere_in_blocks_are_found(spark):
    """Notices of 16 to 28 or 66 to 90 tokens with a word of the page's own in them go, wherever it stands; what fewer pages have stays."""
    rng = random.Random(11)
    notices = [words(rng, n) for n in (*range(15, 28), *range(65, 90, 2))]
    # 80 % of a notice is in one run that is a sampled place's only by chance
    at = [rng.choice([0, 1, len(x) - 1, len(x)]) for x in notices]
    pages = [[" ".join(words(rng, 33)), *(" ".join([*x[:k], f"page{i}", *x[k:]]) for x, k in zip(notices, at, strict=True))] for i in range(4)]
    assert extract(spark, pages) == [x[:1] for x in pages]
    assert extract(spark, pages[:2]) == [[b for b in x if b == x[0] or b.count(" ") + 1 >= h.QUOTED] for x in pages[:2]]


def test_marked_pages_count_for_unmarked_ones(spark):
    """A notice that one unmarked page shares with two marked ones goes from it."""
    rng = random.Random(12)
    notice = words(rng, 40)
    bodies = [f"<p>{' '.join(words(rng, 60))}</p><p>{' '.join([*notice, f'page{i}'])}</p>" for i in range(9)]
    rows = [(i, f"http://a.example/{i}", f"<article>{b}</article>" if i in (1, 2) else b if not i else f"<p>{' '.join(words(rng, 50))}</p>") for i, b in enumerate(bodies)]
    got = {r.page_id: r.text.split("\n") for r in h.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got[0]) == 1 and len(got[1]) == len(got[2]) == 2
