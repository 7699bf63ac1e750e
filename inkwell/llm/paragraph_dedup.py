"""Operator 10: removal of passages that are near copies of an earlier one, by MinHash bands over paragraphs.

Paragraphs are runs of MIN_WORDS words or more: the lines that are as long as that, and, because a passage may stand
inside a longer line or be wrapped over short ones, windows of MIN_WORDS words of the whole text. Windows start where
the word 5-gram has the least hash of STEP successive places, and at both ends of the text, so that any passage of
MIN_WORDS + STEP - 1 words has the same windows in it wherever it stands. A shorter text is one paragraph.

Equal paragraphs are one node. Windows that begin with the same 5-gram, and lines (those as long as a window too) that
collide in MinHash bands of ROWS[0] values, are joined to candidate groups, in which every two are verified by the exact
Jaccard similarity of their word 5-grams. In each component the first paragraph (least doc_id, then place) stays, with those that overlap it; the
words of the others go. A band's nodes are joined to one of them in each task before the shuffle, so that a band of
a third of all rows has a row a task there.

Losses: lines of similarity 0.8 share no band with probability 1e-7; windows that begin alike, and equal paragraphs, are
never missed; windows that begin otherwise are another paragraph, and windows of one text are compared with lines of
33 words or more of another only where equal or similar paragraphs bring them into one group. Nodes are known by 64-bit
hashes of their words.

Defined results: white space isn't compared; null, empty and blank texts have no paragraph; paragraphs that repeat
inside a document are removed there too, but not for overlapping each other; rows that are alike in doc_id and text
count as copies of each other, and keep or lose the same words; a passage of fewer than MIN_WORDS words that isn't a
whole text is none; other columns stay with `filter_documents`, where n_chars follows the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_of, small_batches, stash, table, tidy, with_text
from .near import SHINGLE, THRESHOLD, column_words, components, dealt, distinct, forget, gram_hashes, permutations, ranges, verified, window_starts
from .suffix_dedup import _hashes as span_hashes
from .suffix_dedup import _mix as mix
from .suffix_dedup import _power

MIN_WORDS = 32
STEP = 19
#: Of lines and of windows, whose first 5-gram is the key.
ROWS, BANDS = (3, 0), (24, 1)
WORD_PATTERN = re.compile(r"[^\x20\x09-\x0D]+")


class Items:
    """The paragraphs of some texts, by text and place: text, start (word of the text), size (words), rid; and the words of each text."""

    def __init__(self, column: pa.Array, min_words: int = MIN_WORDS, step: int = STEP):
        self.words, self.n_words, line_sizes = column_words(column)
        ends = np.cumsum(self.n_words)
        begins = ends - self.n_words
        self.grams = gram_hashes(self.words)
        place = [*self._windows(begins, ends, min_words, step)]
        line_ends = np.cumsum(line_sizes)
        long = line_sizes >= min_words
        place.append(((line_ends - line_sizes)[long], line_sizes[long]))
        brief = (self.n_words > 0) & (self.n_words < min_words)
        place.append((begins[brief], self.n_words[brief]))
        at, size = (np.concatenate(x) for x in zip(*place, strict=True))
        keys = distinct(at << 32 | size)
        self.at, self.size = keys >> 32, keys & 0xFFFFFFFF
        self.text = np.searchsorted(ends, self.at, "right")
        self.start = self.at - begins[self.text]
        self.window = self.size == min_words
        self.line = ~self.window | np.isin(keys, place[-2][0] << 32 | place[-2][1])  # a line may be as long as a window
        prefix = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(self.words * _power(2, len(self.words)), out=prefix[1:])
        self.rid = mix(span_hashes(prefix, 0, self.at, self.at + self.size) ^ self.size.astype(np.uint64)).astype(np.int64)

    def _windows(self, begins: np.ndarray, ends: np.ndarray, min_words: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and sizes of the windows, one of several ways to come by them at a time."""
        fits = ends - begins >= min_words
        for starts in (begins[fits], ends[fits] - min_words, window_starts(self.grams, begins, ends, min_words, step)):
            yield starts, np.full(len(starts), min_words, np.int64)

    def bands(self, chosen: np.ndarray, n_bands: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(rid, band key) of the chosen items, those of fewer than SHINGLE words left out; n_bands: of lines and of windows."""
        chosen = np.sort(chosen[self.size[chosen] >= SHINGLE])  # by place, for reduceat
        a, b = permutations(max(n * rows for n, rows in zip(n_bands, ROWS, strict=True)))
        windows, lines = chosen[self.window[chosen]], chosen[self.line[chosen]]
        rids, keys = [], []
        for own, n, rows in zip((lines, windows), n_bands, ROWS, strict=True):
            if not len(own):
                continue
            first, n_grams = self.at[own], self.size[own] - SHINGLE + 1
            grams = self.grams[ranges(first, n_grams)] if rows else self.grams[:0]
            begins, value = np.cumsum(n_grams) - n_grams, np.empty_like(grams)
            for band in range(n):
                key = np.full(len(own), band, np.uint64) if own is lines else self.grams[first] ^ np.uint64(band)
                for p in range(band * rows, band * rows + rows):
                    np.multiply(grams, a[p], out=value)
                    np.add(value, b[p], out=value)
                    low = np.minimum.reduceat(value, begins) >> np.uint64(32)
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
                rids.append(self.rid[own])
                keys.append(key.astype(np.int64))
        return (np.concatenate(rids), np.concatenate(keys)) if rids else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _parts(batch: pa.RecordBatch, column: int, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices with about so many bytes of text."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def _listed(min_words: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, 2):
                x = Items(batch.column(2), min_words, step)
                n = np.bincount(x.text, minlength=batch.num_rows)
                columns = [batch.column(0), batch.column(1), pa.array(x.n_words), _lists(x.start, n, pa.int32()), _lists(x.size, n, pa.int32()), _lists(x.rid, n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "n_words", "starts", "sizes", "rids"])

    return tidy(run, forget), "key long, doc_id long, n_words long, starts array<int>, sizes array<int>, rids array<long>"


def _banded(min_words: int, step: int, bands: tuple[int, int]):
    """(band, a, null): a node of a band; (any number, a, b): two nodes that share a band in this batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found = []
            for batch in _parts(whole, 0):
                x = Items(batch.column(0), min_words, step)
                found.append(x.bands(np.unique(x.rid, return_index=True)[1], bands))
            rid, band = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            if not len(rid):
                continue
            order = np.argsort(band)
            rid, band = rid[order], band[order]
            head = np.concatenate([[True], band[1:] != band[:-1]])
            least = np.minimum.reduceat(rid, np.flatnonzero(head))
            first = least[np.cumsum(head) - 1]
            first, rid = first[rid != first], rid[rid != first]
            order = np.lexsort((rid, first))
            first, rid = first[order], rid[order]
            new = np.ones(len(rid), bool)
            new[1:] = (first[1:] != first[:-1]) | (rid[1:] != rid[:-1])
            first, rid = first[new], rid[new]
            yield pa.RecordBatch.from_arrays([pa.array(band[head]), pa.array(least), pa.nulls(len(least), pa.int64())], ["band", "a", "b"])
            if len(rid):
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(first), pa.array(rid)], ["band", "a", "b"])

    return tidy(run, forget), "band long, a long, b long"


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rids, bodies = [], []
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            words = WORD_PATTERN.findall(text.as_py() or "")
            for x in wanted.as_py():
                rids.append(x["rid"])
                bodies.append(" ".join(words[x["at"] : x["at"] + x["size"]]))
        yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(bodies, pa.string())], ["rid", "body"])


def _keyed(docs: DataFrame) -> DataFrame:
    doc = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(doc, F.coalesce(F.col("text"), F.lit(""))).alias("key"), doc.alias("doc_id"), "text")


def repeated_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, step: int = STEP, threshold: float = THRESHOLD, bands: tuple[int, int] = BANDS) -> tuple[DataFrame, DataFrame]:
    """The listed rows, and key, doc_id, at, size, head, total (paragraphs of the class), first (doc_id, key, at, size) of each paragraph whose class has two."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    listed = stash(keyed.mapInArrow(*_listed(min_words, step)), "paragraphs")
    banded = keyed.select("text").mapInArrow(*_banded(min_words, step, bands))
    edges = banded.select("a", F.coalesce("b", F.min("a").over(Window.partitionBy("band"))).alias("b"))
    groups = components(edges).select(F.col("node").alias("_node"), F.col("comp").alias("group"))

    each = listed.select("key", "doc_id", F.explode(F.arrays_zip("starts", "sizes", "rids")).alias("x")).select("key", "doc_id", F.col("x.starts").alias("at"), F.col("x.sizes").alias("size"), F.col("x.rids").alias("rid"))
    nodes = each.groupBy("rid").agg(F.min(F.struct("doc_id", "key", "at", "size")).alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = stash(nodes.join(groups, F.col("rid") == F.col("_node"), "left").filter("n > 1 OR group IS NOT NULL").drop("_node"), "nodes")

    near = nodes.filter("group IS NOT NULL")
    asked = near.groupBy("first.key").agg(F.collect_list(F.struct("first.at", "first.size", "rid")).alias("wanted")).withColumnRenamed("key", "_key")
    bodies = keyed.join(asked, F.col("key") == F.col("_key")).select("text", "wanted").mapInArrow(_bodies, "rid long, body string")
    cells = dealt(near.select("group", "rid", (F.col("first.size") * 7).alias("size")), "group").withColumnRenamed("rid", "_rid")
    members = bodies.dropDuplicates(["rid"]).join(cells, F.col("rid") == F.col("_rid")).select("group", "rid", F.lit(1).cast("long").alias("weight"), "body", "k", "mine")
    _, edges = verified(members, "group", threshold)
    classes = components(edges).select(F.col("node").alias("_node"), "comp")

    joined = nodes.join(classes, F.col("rid") == F.col("_node"), "left").withColumn("head", F.coalesce("comp", "rid"))
    heads = joined.groupBy("head").agg(F.min("first").alias("first"), F.sum("n").alias("total")).filter("total > 1").withColumnRenamed("head", "_head")
    found = joined.select(F.col("rid").alias("_rid"), "head").join(heads, F.col("head") == F.col("_head")).select("_rid", "head", "total", "first")
    return listed, each.join(found, F.col("rid") == F.col("_rid")).select("key", "doc_id", "at", "size", "head", "total", "first")


def _starts_of(keys: list[np.ndarray]) -> np.ndarray:
    """Where a run of equal keys begins; keys are sorted."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _ends_before(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The greatest end before each row since its run's first row; -1 at these."""
    run = np.cumsum(first).astype(np.int64) << 32
    before = np.concatenate([[0], np.maximum.accumulate(run + end)[:-1]]) - run
    return np.where(first, -1, before)


def _united(row: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last + 1) of the runs of words that the paragraphs of a row cover together."""
    if not len(row):
        return row, at, end
    order = np.lexsort((end, at, row))
    row, at, end = row[order], at[order], end[order]
    begins = np.flatnonzero(_starts_of([row]) | (at > _ends_before(_starts_of([row]), end)))
    return row[begins], at[begins], np.maximum.reduceat(end, begins)


def settled(row: np.ndarray, at: np.ndarray, size: np.ndarray, head: np.ndarray, total: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of paragraphs of documents (row), sorted by row, head (class) and place: which repeat, and which of these go.

    own: the class's first paragraph is in the document. It stays, with those that overlap it or each other from there
    on; a class of which there is no more than that only overlaps itself.
    """
    first = _starts_of([row, head])
    run = np.cumsum(first) - 1
    broken = np.cumsum((at >= _ends_before(first, at + size)) & ~first)  # a gap before it, in any run
    stays = own & (broken == broken[first][run])
    repeats = ~(own & (np.bincount(run, stays)[run] == total))
    return repeats, repeats & ~stays


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column(batch.num_columns - 1)
        n = batch.num_rows
        flat = marks.flatten()
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False))
        at, size, head, total, own = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "size", "head", "total", "own"))
        order = np.lexsort((size, at, head, row))
        row, at, size, head, total, own = (x[order] for x in (row, at, size, head, total, own))
        repeats, goes = settled(row, at, size, head, total, own.astype(bool)) if n and len(row) else (np.zeros(0, bool),) * 2
        words = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
        for k, chosen in enumerate((repeats, goes)):
            of, a, b = _united(row[chosen], at[chosen], at[chosen] + size[chosen])
            words[k] += np.bincount(of, b - a, n).astype(np.int64)
        spans = np.bincount(of, minlength=n).astype(np.int64)
        firsts = flat.field("first_doc").take(pa.array(order[repeats]))
        known = firsts.is_valid().to_numpy(zero_copy_only=False)
        pair = np.unique(np.column_stack([row[repeats][known], firsts.filter(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64)]), axis=0)
        classes = _lists(pair[:, 1], np.bincount(pair[:, 0], minlength=n), pa.int64())
        gone = _lists(np.column_stack([a, b]).ravel(), 2 * spans, pa.int32())
        columns = [*batch.columns[:-1], pa.array(words[0]), pa.array(words[1]), pa.array(spans), classes, gone]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_repeated", "n_removed", "n_spans", "class_ids", "gone"])


_SUMS = "n_repeated long, n_removed long, n_spans long, class_ids array<long>, gone array<int>"


def _marks(marked: DataFrame) -> DataFrame:
    own_first = (F.col("first.key") == F.col("key")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
    mark = F.struct("at", "size", "head", "total", F.coalesce(own_first, F.lit(False)).alias("own"), F.col("first.doc_id").alias("first_doc"))
    return marked.groupBy(F.col("key").alias("_key"), F.col("doc_id").alias("_doc")).agg(F.collect_set(mark).alias("marks"))


def dedup_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, step: int = STEP, threshold: float = THRESHOLD, bands: tuple[int, int] = BANDS) -> DataFrame:
    """doc_id, n_words, n_paragraphs, n_repeated (words in paragraphs of which there are two or more), n_removed (words that go), n_spans
    (runs of these), class_ids (of the repeated paragraphs: the doc_id that holds the first of each class, if it has one)."""
    listed, marked = repeated_paragraphs(docs, min_words, step, threshold, bands)
    rows = listed.select("key", "doc_id", "n_words", F.size("starts").cast("long").alias("n_paragraphs"))
    joined = rows.join(_marks(marked), (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    found = joined.select("doc_id", "n_words", "n_paragraphs", "marks").mapInArrow(_summed, f"doc_id long, n_words long, n_paragraphs long, {_SUMS}")
    return found.drop("gone")


def without_words(text: str, gone: list[int]) -> str:
    """gone: first and last + 1 of each run of words that goes."""
    places = [m.start() for m in WORD_PATTERN.finditer(text)] + [len(text)]
    left, at = [], 0
    for a, b in zip(gone[::2], gone[1::2], strict=True):
        left.append(text[at : places[a]])
        at = places[b]
    return "".join([*left, text[at:]])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [without_words(t, g) if g else t for t, g in zip(batch.column(0).field("text").to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["_row", "_kept"])


def filter_documents(docs: DataFrame, min_words: int = MIN_WORDS, step: int = STEP, threshold: float = THRESHOLD, bands: tuple[int, int] = BANDS) -> DataFrame:
    """docs without the words that go."""
    _, marked = repeated_paragraphs(docs, min_words, step, threshold, bands)
    gone = _marks(marked).mapInArrow(_summed, f"_key long, _doc long, {_SUMS}").filter("n_removed > 0").select("_key", "_doc", "gone")
    doc = F.col("_row.doc_id").cast("long")
    rows = docs.select(row_of(docs).alias("_row")).withColumn("_of", F.xxhash64(doc, F.coalesce(F.col("_row.text"), F.lit(""))))
    joined = rows.join(gone, (F.col("_of") == F.col("_key")) & doc.eqNullSafe(F.col("_doc")), "left").select("_row", "gone")
    kind = joined.select("_row").schema.add("_kept", "string")
    return joined.mapInArrow(_cut, kind).select(*with_text(F.col("_row"), docs.columns, F.col("_kept")))


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_paragraphs(table(spark, sf_dir, "documents"))
