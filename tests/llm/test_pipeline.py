"""The pipeline's stages on the small fixture, each on what the one before kept, and run() against brute force."""

import collections
import random

import corpus_pipeline
import sentencepiece
import xxhash
from inkwell.llm import line_dedup, quality_rules, sentence_piece
from inkwell.llm.common import stash


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, columns, left = [], docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, small), name)
        names.append(name)
        if name != "sentence_piece":
            assert docs.columns == columns
        assert docs.count() <= left
        left = docs.count()
    assert names == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "sentence_piece"]
    ids = {r.doc_id for r in docs.collect()}
    assert 10 in ids or 11 in ids
    # contaminated, and too short; what line dedup has left of a copy is another text, and stays
    assert not ids & {400, 401, 402, 500, 501, 502, 503}


def test_run_on_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def kept_by_rules(rows):
    """(id, text, host) to the same without frequent lines, of those that the rules keep."""
    normal = lambda x: " ".join(x.lower().split()).translate(str.maketrans("123456789", "000000000"))
    holders = collections.defaultdict(set)
    for _, t, h in rows:
        for x in t.split("\n"):
            holders[h, normal(x)].add(t)
    out = []
    for d, t, h in rows:
        w = t.split()
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = collections.Counter(three)
        twice = {i + k for i, x in enumerate(three) if count[x] > 1 for k in range(3)}
        often = [x for x in t.split("\n") if x.split() and len(holders[h, normal(x)]) > quality_rules.MIN_DOCS]
        gone = sum(len(x.split()) for x in often)
        if len(w) >= 50 and 100 * len(twice) <= 50 * len(w) and len(w) - gone >= quality_rules.MIN_LEFT * len(w):
            out.append((d, "\n".join(x for x in t.split("\n") if x not in often) if often else t, h))
    return out


def chunks_by_definition(text):
    """Lists of lines: a chunk ends after a line where the hash of it and the line before is a multiple of MEAN_LINES, from the second on."""
    out, own, lines = [], [], text.split("\n")
    for i, line in enumerate(lines):
        own.append(line)
        h = [xxhash.xxh64_intdigest(x.encode()) if x is not None else 0 for x in (lines[i - 1] if i else None, line)]
        rolled = (h[0] * 0x9E3779B97F4A7C15 + h[1]) % (1 << 64)
        if len(own) >= line_dedup.MIN_LINES and (rolled >> 20) % line_dedup.MEAN_LINES == 0:
            out.append(own)
            own = []
    return [*out, own] if own else out


def without_chunks(rows):
    seen, out = set(), []
    for d, t, h in sorted(rows):
        parts, left = chunks_by_definition(t), []
        for c in parts:
            if len(c) >= line_dedup.MIN_LINES and tuple(c) in seen:
                continue
            if len(c) >= line_dedup.MIN_LINES:
                seen.add(tuple(c))
            left.append(c)
        out.append((d, t if len(left) == len(parts) else "\n".join(x for c in left for x in c), h))
    return out


def one_of_each(rows):
    def grams(t):
        w = t.split()
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets, up = [grams(t) for _, t, _ in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [r for i, r in enumerate(rows) if root(i) == i]


def without_items(rows, items):
    grams = lambda t: [tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)]
    out = []
    for r in rows:
        g, best = grams(r[1]), 0.0
        for item in map(grams, items):
            for s in range(len(g) - len(item) + 1):
                both = sum((collections.Counter(g[s : s + len(item)]) & collections.Counter(item)).values())
                best = max(best, both / (2 * len(item) - both))
        if best < 0.8:
            out.append(r)
    return out


def test_run_equals_brute_force(spark, tmp_path):
    """Frequent lines, texts that are too short or repeat themselves or lose most words, repeated chunks, near copies, items whole and cut."""
    rng = random.Random(17)
    line = lambda n: " ".join(words(rng, n))
    notice, block, items = f"{line(12)} 2024", [line(6) for _ in range(9)], [line(30), line(45)]
    base = [[line(rng.randint(4, 20)) for _ in range(rng.randint(8, 14))] for _ in range(40)]
    rows = [(i, "\n".join(x), f"s{i % 3}") for i, x in enumerate(base)]
    rows += [(100 + i, "\n".join([*base[0][: i % 5], notice.replace("2024", str(2000 + i)), line(70)]), "s0") for i in range(14)]
    rows += [(200 + i, "\n".join([line(40), *block, line(30 + i)]), "s1") for i in range(5)]
    for i in range(6):
        w = " ".join(base[5]).split()
        w[7 * i + 3] = f"edit{i}"
        rows.append((300 + i, " ".join(w), "s2"))
    rows += [(400, line(20), "s0"), (401, " ".join(words(rng, 3) * 40), "s0"), (402, "\n".join([notice] * 8 + [line(4)]), "s0")]
    rows += [(500, f"{line(40)} {items[0]} {line(9)}", "s1"), (501, " ".join(items[1].split()[3:]) + f" {line(40)}", "s1"), (502, f"{line(60)} {' '.join(items[1].split()[:20])}", "s1"), (503, f"{line(60)} {items[0].upper()}", "s2")]
    rng.shuffle(rows)
    top = str(tmp_path)
    frame = spark.createDataFrame([(d, t, "en", h, len(t)) for d, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(4).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")

    steps = [sorted(rows)]
    for step in (kept_by_rules, without_chunks, one_of_each, lambda r: without_items(r, items)):
        steps.append(step(steps[-1]))
    sizes, texts = [len(s) for s in steps], [sum(len(t) for _, t, _ in s) for s in steps]
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] and texts[1] > texts[2]
    library = sentencepiece.SentencePieceProcessor(model_file=sentence_piece.MODEL)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, top).collect()}
    assert {d: list(r.ids) for d, r in got.items()} == {d: library.encode(t) for d, t, _ in steps[-1]}
    assert all(r.parity and r.round_trip and r.n_ids == len(r.ids) for r in got.values())
