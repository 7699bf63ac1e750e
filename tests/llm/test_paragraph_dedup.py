"""Operator 10 against brute force: paragraphs by their definition, every two compared, and passages that stand anywhere."""

import collections
import random

import numpy as np
import pyarrow as pa

from inkwell.llm import near
from inkwell.llm import paragraph_dedup as p
from inkwell.llm.near import column_words


def paragraphs(text):
    """(start, size) by the definition."""
    out, at = set(), 0
    for line in (text or "").split("\n"):
        n = len(line.split())
        if n >= p.MIN_WORDS:
            out.add((at, n))
        at += n
    words = (text or "").split()
    if 0 < at < p.MIN_WORDS:
        return [(0, at)]
    last = at - p.MIN_WORDS
    if last >= 0:
        g = [int(x) for x in p.Items(pa.array([text])).grams]
        starts = {0, last} | {min(range(i, i + p.STEP), key=g.__getitem__) for i in range(last + 2 - p.STEP)}
        out |= {(s, p.MIN_WORDS) for s in starts}
    return sorted(out)


def grams(words):
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute_force(docs):
    """n_repeated, n_removed and class_ids of each of docs (unique doc_ids)."""
    own = [(d, s, n, tuple(t.split()[s : s + n])) for d, t in sorted((d, t or "") for d, t in docs) for s, n in paragraphs(t)]
    sets = [grams(x[3]) for x in own]
    up = list(range(len(own)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = collections.defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].add(i)
    for i, s in enumerate(sets):
        for j in set().union(*(holders[g] for g in s)):
            windows = own[i][2] == own[j][2] == p.MIN_WORDS
            if j > i and (not windows or own[i][3][:5] == own[j][3][:5]) and len(s & sets[j]) >= 0.8 * len(s | sets[j]) - 1e-9:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    classes = collections.defaultdict(list)
    for i in range(len(own)):
        classes[root(i)].append(own[i])
    repeated, gone, firsts = (collections.defaultdict(set) for _ in range(3))
    for members in classes.values():
        members.sort(key=lambda m: m[:3])
        first, end, stay = members[0], 0, []
        for m in members:
            if m[0] == first[0] and (not stay or m[1] < end) and len(stay) == members.index(m):
                stay.append(m)
                end = max(end, m[1] + m[2])
        if len(stay) == len(members):
            continue
        for m in members:
            repeated[m[0]] |= set(range(m[1], m[1] + m[2]))
            firsts[m[0]].add(first[0])
        for m in members[len(stay) :]:
            gone[m[0]] |= set(range(m[1], m[1] + m[2]))
    return {d: (len(repeated[d]), len(gone[d]), sorted(firsts[d])) for d, _ in docs}, gone


def found(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return frame, {r.doc_id: r for r in p.dedup_paragraphs(frame, bands=(12, 12)).collect()}


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_equals_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    count = collections.Counter(d for d, _ in docs)
    docs = [(d, t) for d, t in docs if d is not None and count[d] == 1]
    want, gone = brute_force(docs)
    frame, got = found(spark, docs)
    assert {d: (r.n_repeated, r.n_removed, r.class_ids) for d, r in got.items()} == want and any(w[1] for w in want.values())
    assert all(r.n_paragraphs == len(paragraphs(t)) and r.n_words == len((t or "").split()) for d, t in docs for r in [got[d]])
    left = {r.doc_id: r.text for r in p.filter_documents(frame, bands=(12, 12)).collect()}
    for d, t in docs:
        assert (left[d] or "").split() == [w for i, w in enumerate((t or "").split()) if i not in gone[d]]
        assert gone[d] or left[d] == t


def test_passages_of_fifty_words_are_found_wherever_they_stand(spark):
    """In longer lines, over short lines, at the ends, and twice in one text; texts without one keep all words."""
    rng = random.Random(10)
    passages = [words(rng, 51 + i) for i in range(20)]
    docs = []
    for i, x in enumerate(passages):
        docs.append((10 * i, " ".join(words(rng, 100) + x + words(rng, 110))))
        docs.append((10 * i + 1, "\n".join(" ".join(w) for w in [words(rng, 70), *(x[k : k + 7] for k in range(0, len(x), 7)), words(rng, 30)])))
        docs.append((10 * i + 2, " ".join(x + words(rng, 60))))
        docs.append((10 * i + 3, " ".join(words(rng, 60) + x)))
        docs.append((10 * i + 4, " ".join(words(rng, 33) + x + words(rng, 40) + x)))
        docs.append((10 * i + 5, " ".join(words(rng, 200))))
    _, got = found(spark, docs)
    for d, r in got.items():
        i, kind = divmod(d, 10)
        if kind == 5:
            assert (r.n_repeated, r.n_removed, r.class_ids) == (0, 0, [])
        else:
            # a window may hold three other words
            assert p.MIN_WORDS <= r.n_repeated <= (len(passages[i]) + 6) * (1 + (kind == 4)) and 10 * i in r.class_ids
            assert (r.n_removed > 0) == (kind > 0)


def test_near_lines_and_overlaps(spark):
    """Lines with an edited word go; a text that only overlaps itself stays; what repeats inside a text goes there."""
    rng = random.Random(11)
    line, loop = words(rng, 90), words(rng, 3) * 40
    edited = [*line[:44], "edit", *line[45:]]
    docs = [(1, " ".join(line) + "\nend"), (2, "start\n" + " ".join(edited)), (3, " ".join(words(rng, 40))), (4, " ".join(words(rng, 35) + line[:60] + words(rng, 20) + line[:60])), (5, " ".join(loop))]
    want, _ = brute_force(docs)
    _, got = found(spark, docs)
    assert {d: (r.n_repeated, r.n_removed, r.class_ids) for d, r in got.items()} == want
    assert got[1].n_removed == 0 and got[1].n_repeated >= 90 and got[2].n_removed >= 90 and got[3].n_repeated == 0


def test_rows_that_are_alike(spark):
    rng = random.Random(12)
    text = " ".join(words(rng, 80))
    docs = [(1, text), (1, text), (2, text), (None, None), (None, text), (3, None), (1, "another text " + " ".join(words(rng, 50)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_repeated, r.n_removed) for r in p.dedup_paragraphs(frame).collect())
    assert got == {(1, 80, 80): 2, (2, 80, 80): 1, (None, 0, 0): 1, (None, 80, 0): 1, (3, 0, 0): 1, (1, 0, 0): 1}
    assert len(p.filter_documents(frame.withColumn("_row", frame.doc_id).withColumn("_key", frame.text)).columns) == 4


def test_recall_on_given_tables(spark):
    """Of the documents that share a run of 50 words with another text, at least 0.98 have a repeated paragraph."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    holders = collections.defaultdict(set)
    for d, t in docs:
        w = t.split()
        for i in range(len(w) - 49):
            holders[hash(tuple(w[i : i + 50]))].add(d)
    shared = set().union(*(h for h in holders.values() if len(h) > 1))
    got = {r.doc_id for r in p.op10_paragraph_dedup(spark, "/root/testdata/sf0.01").filter("n_repeated > 0").collect()}
    assert len(shared) > 100 and len(shared & got) >= 0.98 * len(shared)


def test_words_of_a_column():
    texts = ["ab  cd\n\nef\tab", None, "", " \n ", "ab", "é\u00a0日 x\r\ny z\nab", "\n\nab cd", "ab"]
    for column in (pa.array(texts), pa.array(["zz", *texts, "zz"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        hashes, n_words, lines = column_words(column)
        words = [w for t in texts for w in p.WORD_PATTERN.findall(t or "")]
        assert n_words.tolist() == [len(p.WORD_PATTERN.findall(t or "")) for t in texts]
        assert lines.tolist() == [n for t in texts for x in (t or "").split("\n") if (n := len(p.WORD_PATTERN.findall(x)))]
        known = dict(zip(words, hashes.tolist(), strict=True))
        assert len(set(known.values())) == len(set(words)) and [known[w] for w in words] == hashes.tolist()
    assert column_words(pa.array([], pa.string()))[0].dtype == np.uint64


def test_no_pair_of_windows_or_short_lines_is_left_out(spark):
    """Texts of 32 words that differ in the last three (similarity 25/31), and lines of 32 words with a copy of 33 (28/29)."""
    rng = random.Random(13)
    docs = []
    for i in range(150):
        line = words(rng, p.MIN_WORDS)
        docs += [(10 * i, " ".join(line)), (10 * i + 1, " ".join([*line[:-3], *words(rng, 3)]))]
        line = words(rng, p.MIN_WORDS)
        docs += [(10 * i + 2, " ".join(line)), (10 * i + 3, " ".join([*line, "more"]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in p.dedup_paragraphs(frame).collect()}
    assert [d for d, r in got.items() if r.n_repeated < p.MIN_WORDS or r.class_ids != [d // 10 * 10 + d % 10 // 2 * 2]] == []


def test_large_groups_are_compared_without_wide_matrices(monkeypatch):
    """Groups of 40 texts of some 40 words have few shingles that repeat; a matrix of 4096 columns each took most of the time."""
    rng = random.Random(14)
    line = words(rng, 40)
    texts = [" ".join([*line[:-1], *words(rng, 1)]) for _ in range(30)] + [" ".join(words(rng, 40)) for _ in range(10)] + ["", "a b", "a b", *["x y z z z z z z z"] * 2]
    sets = near.shingle_sets(pa.array(texts))
    assert [set(s.tolist()) for s in sets] == [{*near.gram_hashes(column_words(pa.array([t]))[0], min(5, len(t.split()))).tolist()} if t else set() for t in texts]
    assert all((s[1:] > s[:-1]).all() for s in sets)
    cells, zeros = [], np.zeros
    monkeypatch.setattr(near.np, "zeros", lambda shape, *kind: cells.append(np.prod(shape)) or zeros(shape, *kind))
    common = near.intersections(sets)
    monkeypatch.undo()
    assert common.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets] for x in sets]
    assert max(cells) <= len(sets) * max(len(sets), 50)


def test_forests_join_what_pairs_join():
    rng = random.Random(15)
    for n in (1, 2, 5, 40, 300):
        for many in (0, 1, n // 2, 3 * n):
            pairs = np.array([rng.sample(range(n), 2) for _ in range(many if n > 1 else 0)], np.int64).reshape(-1, 2).T
            edges = near.forest((pairs[0], pairs[1]), n)
            both = [collections.defaultdict(set), collections.defaultdict(set)]
            for of, some in zip(both, (pairs.T.tolist(), edges), strict=True):
                top = list(range(n))
                for a, b in some:
                    top = [min(top[a], top[b]) if t in (top[a], top[b]) else t for t in top]
                for x, t in enumerate(top):
                    of[t].add(x)
            assert both[0] == both[1] and len(edges) == n - len(both[0])
