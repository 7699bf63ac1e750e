"""Operator 1: self-join of documents on the Jaccard similarity of word 5-grams, with Bayesian pruning.

Texts with one set of shingles are one node. MinHash bands give buckets; inside a bucket (split into cells of
bounded size) the MinHash values of two nodes are compared STEP at a time, and a pair is dropped as soon as the
posterior probability (uniform prior) that its similarity reaches the threshold is below TOLERANCE. What the
survivors hang together is a candidate group. There every two sets are compared exactly, again in cells, and
the links of each node are counted where they are found: no pair is ever a row, however large a group of copies.

Losses: a pair of similarity 0.8 shares no band with probability (1 - 0.8**4)**32 < 1e-7, and is pruned with
about TOLERANCE. Nodes are known by 64-bit hashes.

Defined results: words stand between ASCII white space; a text of fewer than five words is one shingle; null, empty and blank texts link to nothing and
are classes of their own; repeated rows get one row each, and count as copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_of, small_batches, stash, table, tidy
from .near import THRESHOLD, band_keys, components, dealt, forest, meeting, minhashes, shingle_sets, verified

BANDS, ROWS = 32, 4
STEP = 16
TOLERANCE = 1e-6
BUCKET_CELL = 512
_NO_ID = -(1 << 63)


def _rid(items: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(items.tobytes()) - (1 << 63)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            rids, bands, low = [], [], []
            for items in shingle_sets(batch.column(1)):
                if len(items):
                    signature = minhashes(items, BANDS * ROWS)
                    rids.append(_rid(items))
                    bands.append(band_keys(signature, BANDS, ROWS))
                    low.append((signature & 255).astype(np.uint8).tobytes())
                else:
                    rids.append(None), bands.append(None), low.append(None)
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64())
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip((rids, bands, low), kinds, strict=True)), sizes], ["doc_id", "rid", "bands", "low", "size"])


def cutoffs(threshold: float, tolerance: float = TOLERANCE, total: int = BANDS * ROWS, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped): P(similarity >= threshold | matches) < tolerance."""
    t = threshold + (1 - threshold) / 256  # low bytes also match by chance
    out = []
    for n in range(step, total + 1, step):
        below = np.cumsum([comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(n + 2)])
        out.append((n, int(np.argmax(below >= tolerance))))
    return out


def _pruned(threshold: float):
    steps = cutoffs(threshold)

    def survivors(low: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        a, b = pairs
        matches = np.zeros(len(a), np.int32)
        done = 0
        for n, least in steps:
            matches = matches + (low[a, done:n] == low[b, done:n]).sum(1, dtype=np.int32)
            keep = matches >= least
            a, b, matches, done = a[keep], b[keep], matches[keep], n
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for i, j, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows = members.as_py()
                if len(rows) < 2:
                    continue
                low = np.frombuffer(b"".join(m["low"] for m in rows), np.uint8).reshape(len(rows), -1)
                a, b = np.triu_indices(len(rows), 1)
                if i != j:
                    mine = np.array([m["mine"] for m in rows])
                    keep = mine[a] != mine[b]
                    a, b = a[keep], b[keep]
                out += [(rows[x]["rid"], rows[y]["rid"]) for x, y in forest(survivors(low, (a, b)), len(rows))]
            columns = list(zip(*out, strict=True)) if out else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return run, "a long, b long"


def join_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of what hangs together by links), copy_id (least doc_id with the same shingles), n_links, n_linked_texts."""
    small_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text")
    signed = stash(own.mapInArrow(tidy(_signed), "doc_id long, rid long, bands array<long>, low binary, size long"), "signed")
    nodes = signed.filter("rid IS NOT NULL").groupBy("rid").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"))
    nodes = stash(nodes, "nodes")
    # one row a node: copies have equal bands
    one = signed.filter("rid IS NOT NULL").dropDuplicates(["rid"])
    bands = one.select("rid", F.explode("bands").alias("band"))
    shared = bands.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band"))).filter("n > 1").select("rid", "band")
    lows = one.select(F.col("rid").alias("_rid"), "low")
    shared = meeting(dealt(shared.withColumn("size", F.lit(0)), "band", cell=BUCKET_CELL))
    buckets = shared.join(lows, F.col("rid") == F.col("_rid")).drop("_rid")
    meet = buckets.groupBy("band", "i", "j").agg(F.collect_list(F.struct("mine", "rid", "low")).alias("members"))
    groups = components(meet.select("i", "j", "members").mapInArrow(*_pruned(threshold)))

    asked = groups.join(nodes, F.col("node") == F.col("rid")).select("rid", "comp", F.col("copies").alias("weight"), F.col("first").alias("_first"), "size")
    asked = dealt(asked, "comp")
    members = own.join(asked, F.col("doc_id") == F.col("_first")).select("comp", "rid", "weight", F.col("text").alias("body"), "k", "mine")
    counts, edges = verified(_own_text(members), threshold=threshold)
    classes = components(edges)
    ids = nodes.join(classes.withColumnRenamed("node", "_node"), F.col("rid") == F.col("_node"), "left")
    ids = ids.withColumn("_class", F.coalesce("comp", "rid")).select("rid", "first", "copies", "_class")
    heads = ids.groupBy("_class").agg(F.min("first").alias("class_id")).withColumnRenamed("_class", "_of")
    ids = ids.join(heads, F.col("_class") == F.col("_of")).join(counts.withColumnRenamed("rid", "_rid"), F.col("rid") == F.col("_rid"), "left")
    zero = F.lit(0).cast("long")
    facts = ids.select(F.col("rid").alias("_rid"), "class_id", F.col("first").alias("copy_id"), (F.coalesce("docs", zero) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", zero).alias("n_linked_texts"))
    rows = signed.select("doc_id", "rid").join(facts, F.col("rid") == F.col("_rid"), "left")
    known = lambda c: F.nullif(c, F.lit(_NO_ID))
    return rows.select(
        known(F.col("doc_id")).alias("doc_id"), known(F.coalesce("class_id", "doc_id")).alias("class_id"), known(F.coalesce("copy_id", "doc_id")).alias("copy_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_linked_texts", zero).alias("n_linked_texts")
    )


def _own_text(members: DataFrame) -> DataFrame:
    """Without rows whose text isn't the node's: several texts may have one doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [_rid(items) == r for r, items in zip(batch.column(1).to_pylist(), shingle_sets(batch.column(3)), strict=True)]
            yield batch.filter(pa.array(same, pa.bool_()))

    return members.mapInArrow(tidy(run), members.schema)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class, that of the least doc_id; of rows that repeat it, one. Columns as in docs."""
    facts = stash(join_documents(docs, threshold), "facts")
    gone = facts.filter("NOT doc_id <=> class_id").select(F.col("doc_id").alias("_id"))
    again = facts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id"))
    rows = docs.select(row_of(docs).alias("_row"), F.col("doc_id").cast("long").alias("_doc"))
    same = F.col("_doc").eqNullSafe(F.col("_id"))
    single = rows.join(gone.union(again).distinct(), same, "left_anti").select("_row")
    # the few rows whose doc_id repeats: several texts may have it, and only some of them may stay
    repeated = rows.join(again, same, "left_semi")
    repeated = repeated.mapInArrow(_with_rid, T.StructType([*repeated.schema, T.StructField("_rid", T.LongType())])).dropDuplicates(["_doc", "_rid"])
    stay = facts.filter("doc_id <=> class_id").select(F.col("doc_id").alias("_id")).distinct()
    repeated = repeated.join(stay, same, "left_semi").select("_row")
    return single.unionByName(repeated).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def _with_rid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rids = [_rid(items) for items in shingle_sets(batch.column(0).field("text"))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rids, pa.int64())], [*batch.schema.names, "_rid"])


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))


#: The same by joining shingles, for tables of this size; components by repeated steps along links.
OP1_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g FROM d),
k AS (SELECT doc_id, g, len(g) AS n, md5(array_to_string(g, chr(10))) AS rid FROM s),
t AS (SELECT rid, any_value(g) AS g, any_value(n) AS n, min(doc_id) AS first, count(*) AS copies FROM k WHERE n > 0 GROUP BY rid),
e AS (SELECT rid, n, unnest(g) AS x FROM t),
p AS (SELECT a.rid AS a, b.rid AS b FROM e a JOIN e b ON a.x = b.x AND a.rid <> b.rid GROUP BY a.rid, b.rid, a.n, b.n HAVING count(*) >= {THRESHOLD} * (a.n + b.n - count(*)) - 1e-9),
links AS (SELECT p.a AS rid, count(*) AS texts, sum(t.copies) AS docs FROM p JOIN t ON t.rid = p.b GROUP BY p.a),
reach AS (SELECT rid AS a, rid AS b FROM t UNION SELECT reach.a, p.b FROM reach JOIN p ON p.a = reach.b),
cls AS (SELECT reach.a AS rid, min(t.first) AS class_id FROM reach JOIN t ON t.rid = reach.b GROUP BY reach.a)
SELECT k.doc_id, coalesce(class_id, k.doc_id) AS class_id, coalesce(t.first, k.doc_id) AS copy_id, CAST(coalesce(docs, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links, CAST(coalesce(texts, 0) AS BIGINT) AS n_linked_texts
FROM k LEFT JOIN t ON k.rid = t.rid AND k.n > 0 LEFT JOIN links ON links.rid = t.rid LEFT JOIN cls ON cls.rid = t.rid
"""
