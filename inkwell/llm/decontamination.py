"""Operator 8: documents that hold benchmark items, by SimHash of item-sized windows.

Native: DataFrame functions only. A window is as many words as some item has. A window of similarity `threshold` to
an item has at least 2 * threshold / (1 + threshold) of its 5-grams in common with it; windows with fewer 5-grams
of items of their size can't be similar to one and aren't fingerprinted, all others are, wherever they start.

Their 64-bit SimHash is cut into BLOCKS blocks: two fingerprints within RADIUS differ by RADIUS // BLOCKS bits at
most in one block at least, so that the join of windows' blocks with all values so near to items' blocks finds every
pair within RADIUS. These are verified by the exact weighted Jaccard similarity of their 5-grams (weight: how often
one occurs). At a similarity of 0.8 the distance of fingerprints exceeds RADIUS with probability 4e-4.

Defined results: words are compared in lower case; null and empty texts hold nothing; items of fewer than five
words are left out; repeated rows get their rows each; items with equal texts are each reported, equal rows of the
benchmark once; a document shorter than an item can't hold it; items of any length are counted in lanes that fit.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, row_key, row_of, stash, table, words_of

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 19
BLOCKS = 7
#: Bytes up to which a table of the items is sent to all executors, by a count of its rows and grams; beyond, its join shuffles.
SEND_BYTES = 24 << 20
_NARROW, _WIDE = 16, 32


def _hashes(text: Column) -> Column:
    """Hashes of the 5-grams of a text, in order."""

    def grams(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
        return F.when(F.size(w) >= SHINGLE, each).otherwise(F.array().cast("array<bigint>"))

    return let(words_of(F.lower(text)), grams)


def simhash(grams: Column) -> Column:
    """For each bit, whether it is set in more than half of the hashes. Counts of several bits share a long, in lanes that can't overflow."""
    return F.when(F.size(grams) < 1 << _NARROW, _simhash(grams, _NARROW)).otherwise(_simhash(grams, _WIDE))


def _simhash(grams: Column, width: int) -> Column:
    n = F.size(grams).cast("long")
    ones = sum(1 << k for k in range(0, 64, width))

    def counts(g: int) -> Column:
        return F.aggregate(grams, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, g).bitwiseAND(F.lit(ones)))

    def bits(s: Column) -> Column:
        lanes = [(g + k, F.shiftrightunsigned(s[g], k).bitwiseAND(F.lit((1 << width) - 1))) for g in range(width) for k in range(0, 64, width)]
        values = [F.when(2 * c > n, F.lit((1 << b) - ((1 << 64) if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for b, c in lanes]
        return reduce(lambda a, b: a.bitwiseOR(b), values)

    return let(F.array(*(counts(g) for g in range(width))), bits)


def _edges(blocks: int) -> list[tuple[int, int]]:
    """First bit and last + 1 of blocks of nearly equal width."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _block(fingerprint: Column, a: int, b: int) -> Column:
    return F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1))


def _blocks(fingerprint: Column, blocks: int) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("block"), _block(fingerprint, a, b).alias("value")) for i, (a, b) in enumerate(_edges(blocks))))


def _probes(fingerprint: Column, blocks: int, radius: int) -> Column:
    """(block, value) of all values within radius // blocks bits of each block."""
    masks = [[sum(1 << i for i in c) for k in range(radius // blocks + 1) for c in combinations(range(b - a), k)] for a, b in _edges(blocks)]

    def near(i: int, a: int, b: int) -> Column:
        own = _block(fingerprint, a, b)
        return F.transform(F.lit(masks[i]).cast("array<bigint>"), lambda m: F.struct(F.lit(i).alias("block"), own.bitwiseXOR(m).alias("value")))

    return F.flatten(F.array(*(near(i, a, b) for i, (a, b) in enumerate(_edges(blocks)))))


def _similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser over sum of the greater counts."""
    count = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    single = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    same = F.array_intersect(a, b)
    both = F.when(single, F.size(same)).otherwise(F.aggregate(same, F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x))))
    return both / (F.size(a) + F.size(b) - both)


def _least_common(n: Column, threshold: float) -> Column:
    """How many of its n grams a window has in common, at least, with an item of similarity `threshold`."""
    return F.ceil(n * F.lit(2 * threshold / (1 + threshold)) - F.lit(1e-6)).cast("int")


def _starts(w: Column, last: Column, threshold: float) -> Column:
    """Starts up to `last` of all windows of w.n grams with enough of the places w.at; runs of starts don't overlap."""
    at = F.sort_array(w["at"])

    def runs(p: Column) -> Column:
        need = _least_common(w["n"], threshold)
        low = lambda k: F.greatest(F.get(p, k + need - 1) - w["n"] + 1, F.lit(0), F.when(k > 0, F.least(F.get(p, k - 1), last) + 1).otherwise(0))
        high = lambda k: F.least(F.get(p, k), last)
        each = F.transform(F.sequence(F.lit(0), F.size(p) - need), lambda k: F.when(low(k) <= high(k), F.sequence(low(k), high(k))).otherwise(F.array().cast("array<int>")))
        return F.when(F.size(p) >= need, F.flatten(each)).otherwise(F.array().cast("array<int>"))

    return let(at, runs)


def _sent(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= SEND_BYTES else df


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """_key, doc_id, item_id, start (word), n_words, similarity: the best window of each item in each document."""
    own = items.select(row_key(F.col("item_id"), F.col("text")).alias("_item"), "item_id", _hashes(F.col("text")).alias("_grams")).filter(F.size("_grams") > 0).dropDuplicates(["_item"])
    own = stash(own.select("_item", "item_id", "_grams", F.size("_grams").alias("_n"), simhash(F.col("_grams")).alias("_mark")), "items")
    n_items, n_grams = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    places = own.select(F.col("_n").alias("n"), F.explode("_grams").alias("h")).distinct()

    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = keyed.select("_key", F.posexplode(_hashes(F.col("text"))).alias("p", "_h"))
    seen = hashed.join(_sent(places, 48 * n_grams), F.col("_h") == F.col("h"))
    seen = seen.groupBy("_key", "n").agg(F.collect_set("p").alias("at")).filter(F.size("at") >= _least_common(F.col("n"), threshold))
    seen = seen.groupBy("_key").agg(F.collect_list(F.struct("n", "at")).alias("windows")).withColumnRenamed("_key", "_of")

    found = keyed.join(seen, F.col("_key") == F.col("_of")).select("_key", "doc_id", "windows", _hashes(F.col("text")).alias("g"))
    each = found.select("_key", "doc_id", "g", F.explode("windows").alias("w")).filter(F.col("w.n") <= F.size("g"))
    each = each.select("_key", "doc_id", "g", F.col("w.n").alias("n"), F.explode(_starts(F.col("w"), F.size("g") - F.col("w.n"), threshold)).alias("start"))
    cut = each.select("_key", "doc_id", "n", "start", F.slice("g", F.col("start") + 1, F.col("n")).alias("grams"))
    marked = cut.withColumn("mark", simhash(F.col("grams"))).withColumn("b", F.explode(_blocks(F.col("mark"), blocks)))

    probes = own.select("_item", "_n", "_mark", F.explode(_probes(F.col("_mark"), blocks, radius)).alias("_b"))
    n_probes = n_items * sum(comb(b - a, k) for a, b in _edges(blocks) for k in range(radius // blocks + 1))
    differ = F.col("mark").bitwiseXOR(F.col("_mark"))
    near = marked.join(_sent(probes, 80 * n_probes), (F.col("n") == F.col("_n")) & (F.col("b") == F.col("_b")) & (F.bit_count(differ) <= radius))
    # a pair counts in the first block in which it meets
    meets = [F.when(F.bit_count(_block(differ, a, b)) <= radius // blocks, F.lit(i)) for i, (a, b) in enumerate(_edges(blocks))]
    near = near.filter(F.coalesce(*meets) == F.col("b.block")).select("_key", "doc_id", "start", "grams", F.col("_item").alias("_of"))
    pairs = near.join(_sent(own.select("_item", "item_id", "_grams", "_n"), 64 * n_items + 8 * n_grams), F.col("_of") == F.col("_item"))
    scored = pairs.select("_key", "doc_id", "item_id", "start", "_n", _similarity(F.col("grams"), F.col("_grams")).alias("similarity")).filter(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "_n")).alias("best")
    return scored.groupBy("_key", "doc_id", "item_id").agg(best).select("_key", "doc_id", "item_id", (-F.col("best.back")).alias("start"), (F.col("best._n") + SHINGLE - 1).alias("n_words"), "best.similarity")


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs that hold no item; columns as in docs."""
    found = find_items(docs, items, threshold).select(F.col("_key").alias("_gone")).distinct()
    rows = docs.select(row_of(docs).alias("_row"), row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    left = rows.join(found, F.col("_key") == F.col("_gone"), "left_anti")
    return left.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_key")


_GRAMS = "CASE WHEN len(w) < 5 THEN [] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"
_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
#: Over all windows of the pairs of documents and items that have a 5-gram in common; others have the similarity 0.
OP8_SQL = f"""
WITH i AS (SELECT row_number() OVER () AS iid, item_id, {_GRAMS} AS g FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_GRAMS} AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
meet AS (SELECT DISTINCT rid, iid FROM (SELECT rid, unnest(g) AS x FROM d) JOIN (SELECT iid, unnest(g) AS x FROM i) USING (x)),
wins AS (SELECT rid, iid, unnest(range(0, len(d.g) - len(i.g) + 1)) AS start FROM meet JOIN d USING (rid) JOIN i USING (iid) WHERE len(d.g) >= len(i.g)),
cut AS (SELECT rid, doc_id, item_id, start, i.g AS b, len(i.g) AS n, d.g[start + 1:start + len(i.g)] AS a FROM wins JOIN d USING (rid) JOIN i USING (iid)),
pairs AS (SELECT *, list_intersect(list_distinct(a), b) AS c FROM cut),
scored AS (SELECT rid, doc_id, item_id, start, n, list_sum(list_transform(c, lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS c FROM pairs WHERE len(c) > 0)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(n + {SHINGLE - 1} AS INTEGER) AS n_words, c / (2 * n - c) AS similarity FROM scored WHERE c / (2 * n - c) >= {THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY rid, item_id ORDER BY c / (2 * n - c) DESC, start, n DESC) = 1
"""
