"""Operator 2: removal of byte strings of LENGTH bytes or more that occur anywhere else, by blockwise suffix sorting.

1. Buckets. Of the GRAM-byte strings inside each window of LENGTH bytes, the one with the least hash (the
   leftmost of equals) is the window's anchor. Equal windows have equal anchors at equal offsets, so the anchor
   names the suffix bucket in which a window has all its equals. Successive windows with one anchor make a
   context: the bytes that these windows cover.
2. Counts. Contexts with equal bytes are combined in each task before the shuffle. If a context occurs twice,
   all its windows repeat. A context that is alone with its anchor has no repeated window. No text has moved yet.
3. Sorting. Only for anchors with different contexts the bytes are fetched, one representative for equal ones.
   A task sorts one block of buckets at a time. The bytes are laid out so that anchors fall on multiples of
   PERIOD; suffixes at the places of a difference cover modulo PERIOD are ranked first, with the lengths of their
   common prefixes; a window is then ordered by its first bytes up to the next cover place and, however long the
   tie, by that place's rank. A bucket of more than HOT contexts is split by the bytes next to the anchor: windows
   that begin up to a quarter, a half, ... of their room before it go by all the bytes that they have in common, so
   that a line that stands in many surroundings is dealt out by these. A bucket that is still larger than a block is
   sorted in passes over offsets from the anchor.
4. The windows found are united to spans, removed from each text, and the rest is digested.

Defined results: null and empty texts have no byte; texts shorter than LENGTH lose nothing; a string that
repeats inside one document is removed at each place, overlaps included; copies of a row are documents of their
own, and so are rows with one doc_id and different texts; very long texts are cut into slices for the search,
which changes contexts but no window; other columns are left aside, or carried by `filter_documents`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LENGTH = 200
GRAM = 64
PERIOD = 32
SLICE = 1 << 20
BLOCK = 4 << 20
#: Contexts of a bucket from which it is split, and in how many ranges of offsets.
HOT, RANGES = 2000, 4
_PLACE_BITS = 22
_NO_ID = -(1 << 63)
_RNG = np.random.default_rng(977)
_BYTE = [_RNG.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2)]
_BASE = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(which: int, n: int) -> np.ndarray:
    """Powers of a base (0, 1) or of its inverse (2, 3) modulo 2**64."""
    if len(_powers[which]) < n:
        base = _BASE[which % 2] if which < 2 else pow(_BASE[which % 2], -1, 1 << 64)
        factors = np.full(max(n, SLICE + 2 * LENGTH), base, np.uint64)
        factors[0] = 1
        _powers[which] = np.cumprod(factors)
    return _powers[which][:n]


def _prefix(flat: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[which][flat] * _power(2 + which, len(flat)), out=out[1:])
    return out


def _hashes(prefix: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((prefix[end] - prefix[start]) * _power(which, len(prefix))[start])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def contexts(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts flat[start:end]: number of the text, anchor hash, context hash, first window, windows, place of the anchor."""
    width = LENGTH - GRAM + 1
    n = len(flat) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    first = _prefix(flat, 0)
    grams = np.arange(len(flat) - GRAM + 1)
    hashes = _hashes(first, 0, grams, grams + GRAM)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    anchor = (_least((hashes & ~mask) | grams.astype(np.uint64), width) & mask).astype(np.int64)
    which = np.searchsorted(starts, np.arange(n), "right") - 1
    good = np.arange(n) + LENGTH <= ends[which]
    change = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1]) | (good[1:] != good[:-1])]))
    last = np.concatenate([change[1:], [n]])
    keep = good[change]
    lo, hi = change[keep], last[keep]
    a = anchor[lo]
    second = _prefix(flat, 1)
    c = _mix(_hashes(second, 1, lo, hi - 1 + LENGTH) ^ _mix(((a - lo) * 65536 + (hi - lo)).astype(np.uint64)))
    return which[lo], hashes[a].astype(np.int64), c.astype(np.int64), lo, hi - lo, a


def _slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bounded parts of the texts: bytes, starts and ends in them, numbers of the texts, places of the parts in these."""
    parts: list[tuple[bytes, int, int]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), SLICE):
            part = text[at : at + SLICE + LENGTH - 1]
            if size + len(part) > 2 * SLICE:
                yield _joined(parts)
                parts, size = [], 0
            parts.append((part, i, at))
            size += len(part)
    if parts:
        yield _joined(parts)


def _joined(parts):
    ends = np.cumsum([len(p) for p, _, _ in parts])
    starts = np.concatenate([[0], ends[:-1]])
    return np.frombuffer(b"".join(p for p, _, _ in parts), np.uint8), starts, ends, np.array([i for _, i, _ in parts]), np.array([at for _, _, at in parts])


def _utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """doc, t, anchor hash, context hash, place of the first window, number of windows, offset of the anchor."""
    doc, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    for flat, starts, ends, text_of, at in _slices(_utf8(batch.column(2))):
        part, h, c, lo, n, a = contexts(flat, starts, ends)
        if len(part):
            yield doc[text_of[part]], t[text_of[part]], h, c, lo - starts[part] + at[part], n, a - lo


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts, equal ones of a slice combined."""
    for batch in batches:
        for doc, t, h, c, p, n, a in _found(batch):
            order = np.lexsort((c, h))
            new = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])]))
            count = np.diff(np.concatenate([new, [len(order)]]))
            o = order[new]
            place = t[o].astype(np.int64) << 40 | n[o] << 32 | p[o]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[o], c[o], count.astype(np.int64), doc[o], place, a[o].astype(np.int32))], ["h", "c", "n", "doc", "place", "a"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, t, h, c, p, n, _ in _found(batch):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, doc, t.astype(np.int64) << 40 | n << 32 | p)], ["h", "c", "doc", "place"])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that are asked for."""
    names = ["h", "alone", "doc", "place", "a", "low", "high", "bytes"]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        size = 0
        for doc, text, asked in zip(batch.column(0).to_pylist(), _utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            for x in asked:
                p, n = x["place"] & 0xFFFFFFFF, x["place"] >> 32 & 255
                data = text[p : p + n - 1 + LENGTH]
                for h, low, high in split_bucket(x["h"], data, x["a"]) if x["hot"] else ((x["h"], -LENGTH, LENGTH),):
                    for column, v in zip(rows, (h, x["alone"], doc, x["place"], x["a"], low, high, data), strict=True):
                        column.append(v)
                    size += len(data)
            if size > 8 << 20:
                yield _context_rows(rows, names)
                rows, size = [[] for _ in names], 0
        yield _context_rows(rows, names)


def _context_rows(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)


def split_bucket(h: int, data: bytes, anchor: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, low, high): where the windows of a context with anchors low to high - 1 bytes after their start have all their equals.

    These windows have in common the bytes from low before the anchor's place to LENGTH - high + 1 behind it.
    """
    room = LENGTH - GRAM + 1
    for k in range(RANGES):
        low, high = room * k // RANGES, room * (k + 1) // RANGES
        begin, end = anchor - low, anchor + LENGTH - high + 1
        if begin >= 0 and end <= len(data):  # else no window of this range fits
            yield xxhash.xxh3_64_intdigest(data[begin:end], (h + k) & 0xFFFFFFFFFFFFFFFF) - (1 << 63), low, high


def difference_cover(period: int) -> np.ndarray:
    """Places so that any two numbers have a common shift below `period` that takes both to such places."""
    cover, missing = [0], set(range(1, period))
    while missing:
        best = max((x for x in range(period) if x not in cover), key=lambda x: len(({(x - y) % period for y in cover} | {(y - x) % period for y in cover}) & missing))
        cover.append(best)
        missing -= {(best - y) % period for y in cover} | {(y - best) % period for y in cover}
    return np.array(sorted(cover))


_COVER = difference_cover(PERIOD)
_SHIFT = np.array([min((int(d) - r) % PERIOD for d in _COVER) for r in range(PERIOD)])  # to the next place of the cover


def repeated_windows(items: list[tuple], low: int = -LENGTH, high: int = LENGTH) -> list[np.ndarray]:
    """For contexts (bytes, offset of the anchor, and the range of its windows' offsets, if not all): which windows,
    with anchors low to high - 1 bytes after their start, occur twice in items."""
    items = [(x[0], x[1], *(x[2:] or (-LENGTH, LENGTH))) for x in items]
    begin, at = [], PERIOD
    for data, a, _, _ in items:
        at += (-(at + a)) % PERIOD  # the anchor falls on a multiple of the period
        begin.append(at)
        at += len(data)
    flat = np.zeros(at + 2 * LENGTH, np.uint8)
    for b, (data, *_) in zip(begin, items, strict=True):
        flat[b : b + len(data)] = np.frombuffer(data, np.uint8)
    sizes = [len(x[0]) - LENGTH + 1 for x in items]
    window = np.concatenate([np.arange(b, b + n) for b, n in zip(begin, sizes, strict=True)])
    offset = np.concatenate([x[1] - np.arange(n) for x, n in zip(items, sizes, strict=True)])
    least, most = (np.repeat([x[k] for x in items], sizes) for k in (2, 3))
    hit = np.zeros(len(window), bool)
    chosen = np.flatnonzero((offset >= np.maximum(low, least)) & (offset < np.minimum(high, most)))
    if len(chosen):
        s = window[chosen]
        shift = _SHIFT[s % PERIOD]
        sample, of = np.unique(s + shift, return_inverse=True)
        suffix = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[sample]
        order = np.argsort(np.ascontiguousarray(suffix).view(f"S{LENGTH}").ravel(), kind="stable")
        ranked = suffix[order]
        differ = ranked[1:] != ranked[:-1]
        common = np.where(differ.any(1), differ.argmax(1), LENGTH) if len(ranked) > 1 else np.zeros(0, int)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ranks = np.zeros(len(s), np.int64)
        for d in np.unique(shift):  # of suffixes that agree in the rest of the window, one rank
            rank = np.concatenate([[0], np.cumsum(common < LENGTH - d)])
            own = shift == d
            ranks[own] = rank[place[of[own]]]
        head = np.zeros((len(s), 4), np.uint64)
        for j in range(int(shift.max())):
            head[:, j // 8] |= np.where(shift > j, flat[s + j], 0).astype(np.uint64) << np.uint64(8 * (j % 8))
        keys = (ranks, shift, head[:, 0], head[:, 1], head[:, 2], head[:, 3])
        by = np.lexsort(keys)
        same = np.ones(len(by) - 1, bool)
        for k in keys:
            same &= k[by][1:] == k[by][:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        hit[chosen[by[twice]]] = True
    return np.split(hit, np.cumsum(sizes)[:-1])


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their anchors; complete buckets are gathered up to the size of a block."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        items = [(r[7], r[4], r[5], r[6]) for r in rows]
        size = sum(len(x[0]) for x in items)
        passes = max(1, -(-size // BLOCK))
        step = -(-LENGTH // passes)
        hits = [np.zeros(max(0, len(x[0]) - LENGTH + 1), bool) for x in items]
        for low in range(0, LENGTH, step):
            for hit, more in zip(hits, repeated_windows(items, low, low + step), strict=True):
                hit |= more
        out: list[tuple] = []
        for r, hit in zip(rows, hits, strict=True):
            if r[1]:
                p = r[3] & 0xFFFFFFFF
                out += [(r[2], r[3] >> 40, (p + a) << 32 | (p + b - 1 + LENGTH)) for a, b in _runs(hit)]
        doc, t, span = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(t, pa.int32()), pa.array(span, pa.int64())], ["doc", "t", "span"])

    block: list[tuple] = []
    bucket: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if bucket and row[0] != bucket[0][0]:
                if len(bucket) > 1:
                    more = sum(len(r[7]) for r in bucket)
                    if block and size + more > BLOCK:
                        yield spans(block)
                        block, size = [], 0
                    block += bucket
                    size += more
                bucket = []
            bucket.append(row)
    block += bucket if len(bucket) > 1 else []
    if block:
        yield spans(block)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(_utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for x in sorted(spans or ()):
                a, b = x >> 32, x & 0xFFFFFFFF
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            digest, at = hashlib.sha256(), 0
            for a, b in merged:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            rows.append((len(text), sum(b - a for a, b in merged), len(merged), digest.hexdigest(), [{"a": a, "b": b} for a, b in merged]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans (a, b: byte places)."""
    text: Column = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.coalesce(F.xxhash64(text).bitwiseAND(0x7FFFFF).cast("int"), F.lit(0)).alias("t"), text.alias("text")
    )
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = keyed.mapInArrow(_counted, "h long, c long, n long, doc long, place long, a int").repartition(n, "h")
    one = counted.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "place", "a")).alias("x"))
    of_anchor = one.select("h", "c", "n", "x", F.count(F.lit(1)).over(_by("h")).alias("kinds"), F.min("n").over(_by("h")).alias("least"))
    asked = of_anchor.filter("kinds > 1 AND least = 1").select("h", (F.col("n") == 1).alias("alone"), (F.col("kinds") > HOT).alias("hot"), "x.doc", "x.place", "x.a")
    asked = asked.groupBy("doc", F.shiftright("place", 40).cast("int").alias("t")).agg(F.collect_list(F.struct("h", "alone", "hot", "place", "a")).alias("asked"))
    asked = asked.select(F.col("doc").alias("_doc"), F.col("t").alias("_t"), "asked")
    same = (F.col("doc") == F.col("_doc")) & (F.col("t") == F.col("_t"))
    fetched = keyed.join(asked, same).select("doc", "text", "asked").mapInArrow(_fetched, "h long, alone boolean, doc long, place long, a int, low int, high int, bytes binary")
    sorted_spans = fetched.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_sorted, "doc long, t int, span long")

    twice = one.filter("n > 1").select(F.col("h").alias("_h"), F.col("c").alias("_c"))
    whole = keyed.mapInArrow(_placed, "h long, c long, doc long, place long").join(twice, (F.col("h") == F.col("_h")) & (F.col("c") == F.col("_c")), "left_semi")
    p, w = F.col("place").bitwiseAND(0xFFFFFFFF), F.shiftright("place", 32).bitwiseAND(255)
    whole = whole.select("doc", F.shiftright("place", 40).cast("int").alias("t"), (F.shiftleft(p, 32) + p + w - 1 + LENGTH).alias("span"))
    spans = whole.unionByName(sorted_spans).groupBy("doc", "t").agg(F.collect_list("span").alias("spans")).select(F.col("doc").alias("_doc"), F.col("t").alias("_t"), "spans")
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a: bigint, b: bigint>>"
    found = keyed.join(spans, same, "left").select("doc", "text", "spans").mapInArrow(_cut, kind)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("spans")


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS m FROM d WHERE length(h) >= {2 * LENGTH}),
twice AS (SELECT rid, i FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
edge AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM twice),
spans AS (SELECT rid, k, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k FROM edge) GROUP BY rid, k),
gaps AS (SELECT rid, k, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY k) AS after FROM spans),
kept AS (SELECT d.rid, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY k) || substr(any_value(h), 2 * max(b) + 1) AS h, sum(b - a) AS n_removed, count(*) AS n_spans FROM gaps JOIN d USING (rid) GROUP BY d.rid)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, digest of the rest) of each text; for tests."""
    seen: dict[bytes, int] = {}
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((len(d), int(gone.sum()), len(_runs(gone)), hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out
