"""What the near-duplicate operators share: shingles, MinHash, components, and exact counts inside candidate groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, tidy
from .suffix_dedup import _hashes as span_hashes
from .suffix_dedup import _prefix as byte_prefix

SHINGLE = 5
THRESHOLD = 0.8
CELL = 256
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
CELL_BYTES = 8 << 20
#: Bytes of text that are hashed at a time.
PART_BYTES = 1 << 20
#: Members up to which groups are compared together, and pairs of these at a time.
SMALL, PAIRS = 32, 20_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _WordHashes()


def forget() -> None:
    """Drops the memo of word hashes."""
    _hashes.clear()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the runs of `size` words, in order; h: hashes of the words."""
    out = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for i in range(size):
        out = (out ^ h[i : len(out) + i]) * _MIX[i % 5]
        out ^= out >> np.uint64(29)
    return out


def column_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts of a column of strings, on end: 64-bit hashes of their words (between ASCII white space), how many
    words each text has, and how many each of its lines has that has one. Bytes are hashed without Python objects."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    flat = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    word = ~_SPACES[flat]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    some = edges[1:] > edges[:-1]  # a text's own edges are edges of words
    begins[edges[:-1][some]] = word[edges[:-1][some]]
    ends[edges[1:][some] - 1] = word[edges[1:][some] - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    prefix = byte_prefix(flat, 0)
    hashes = span_hashes(prefix, 0, begins, ends) ^ (ends - begins).astype(np.uint64)
    n_words = np.diff(np.searchsorted(begins, edges))
    breaks = np.flatnonzero(flat == 10)
    line = np.searchsorted(breaks, begins) + np.searchsorted(edges, begins, "right")  # a text or a line end begins another line
    change = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    return hashes, n_words, np.diff(np.append(change, len(line)))


def least_of_runs(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def window_starts(grams: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: int, step: int) -> np.ndarray:
    """Where windows of `size` words start in the segments begins to ends, which follow each other without a gap: at
    the least gram hash of each `step` successive places, so that a run of size + step - 1 words has a window in it, and
    equal runs have the same."""
    if len(grams) < step or not len(ends):
        return np.zeros(0, np.int64)
    bits = np.uint64(max(20, len(grams).bit_length()))
    least = least_of_runs((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), step)
    end_of = np.repeat(ends, ends - begins)[: len(least)]
    inside = np.arange(len(end_of)) + (step - 1 + size) <= end_of
    return distinct((least[: len(end_of)][inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; np.unique hashes numbers, which takes far longer than to sort them."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, on end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of runs of `size` words; of a shorter text, one hash of all its words; of no word, none."""
    out = []
    for at, n_texts in parts_of(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)):
        words, n_words, _ = column_words(column.slice(at, n_texts))
        ends = np.cumsum(n_words)
        counts = np.maximum(n_words - size + 1, 0)
        items, number = np.unique(gram_hashes(words, size)[ranges(ends - n_words, counts)], return_inverse=True)
        have = distinct(np.repeat(np.arange(n_texts) * len(items), counts) + number)  # by text and hash, without a loop over texts
        edges = np.searchsorted(have, np.arange(n_texts + 1) * len(items))
        values = items[have - np.repeat(np.arange(n_texts) * len(items), np.diff(edges))]
        edges = edges.tolist()
        sets = [values[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for i in np.flatnonzero((n_words > 0) & (n_words < size)).tolist():
            sets[i] = gram_hashes(words[ends[i] - n_words[i] : ends[i]], int(n_words[i]))
        out += sets
    return out


def parts_of(sizes: np.ndarray, most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """(first, how many) of parts of a batch that have about so many bytes; hashing takes some 30 times a part's bytes."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, end - at
        at = end


def minhashes(items: np.ndarray, n: int) -> np.ndarray:
    """The least of n permuted 32-bit hashes."""
    a, b = permutations(n)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(items), 2048):
        out = np.minimum(out, ((items[i : i + 2048, None] * a + b) >> np.uint64(32)).astype(np.uint32).min(0))
    return out


_known: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _known:
        rng = np.random.default_rng(4711)
        _known[n] = tuple(rng.integers(0, 1 << 63, (2, n), dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    return _known[n]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> list[int]:
    """One 64-bit key a band, which names the band too."""
    part = signature[: bands * rows].reshape(bands, rows)
    return [xxhash.xxh64_intdigest(p.tobytes(), i) - (1 << 63) for i, p in enumerate(part)]


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the least node that it hangs together with; edges: a, b (long).

    Each round maps every node to the least of its neighbours and contracts the edges; with hashed node ids the
    rest shrinks by a factor each round. All state is in tables in the shared folder.
    """
    edges = stash(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        if labels is None:
            labels = least.select(F.col("a").alias("node"), F.col("m").alias("comp"))
        else:
            step = least.select(F.col("a").alias("_a"), "m")
            labels = stash(labels.join(step, F.col("comp") == F.col("_a"), "left").select("node", F.coalesce("m", "comp").alias("comp")), "labels")
        left = least.select(F.col("a").alias("_a"), F.col("m").alias("_ma"))
        right = least.select(F.col("a").alias("_b"), F.col("m").alias("_mb"))
        moved = edges.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
        edges = stash(moved.filter("_ma <> _mb").select(F.least("_ma", "_mb").alias("a"), F.greatest("_ma", "_mb").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")) if labels is None else labels


def forest(pairs: tuple[np.ndarray, np.ndarray], n: int) -> list[tuple[int, int]]:
    """Edges that join what the pairs join, fewer than n."""
    a, b = np.minimum(*pairs), np.maximum(*pairs)
    least = np.arange(n)
    np.minimum.at(least, b, a)
    found = [(i, j) for j, i in enumerate(least.tolist()) if i != j]  # of each node the edge to its least one
    top = least
    while (top[top] != top).any():
        top = top[top]
    left = top[a] != top[b]  # few pairs, which these don't join
    up = top.tolist() if left.any() else []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in zip(a[left].tolist(), b[left].tolist(), strict=True):
        x, y = root(i), root(j)
        if x != y:
            up[max(x, y)] = min(x, y)
            found.append((i, j))
    return found


def dealt(members: DataFrame, group: str, cell: int = CELL, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """members (group, rid, size) of groups of two or more, with k, the cells of its group, and mine, its own cell.

    Cells hold about `cell` members and `cell_bytes` of size. Do this before anything large is joined to the members.
    """
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_bytes")).withColumnRenamed(group, "_group")
    joined = members.join(sizes.filter("_n > 1"), F.col(group) == F.col("_group"))
    k = F.greatest(F.ceil(F.col("_n") / cell), F.ceil(F.col("_bytes") / cell_bytes)).cast("int")
    return joined.withColumn("k", k).withColumn("mine", F.pmod(F.xxhash64("rid", F.lit(7)), F.col("k")).cast("int")).drop("_group", "_n", "_bytes", "size")


def meeting(members: DataFrame) -> DataFrame:
    """Dealt members with i and j: every two of a group meet in one (group, i, j), which holds two cells."""
    spread = members.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return spread.withColumn("i", F.least("mine", "_x")).withColumn("j", F.greatest("mine", "_x")).drop("_x", "k")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common parts of every two sets."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    items = np.concatenate(sets)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    new = np.concatenate([[True], items[1:] != items[:-1]])
    column = np.cumsum(new) - 1
    many = np.bincount(column) > 1
    keep = many[column]
    column = (np.cumsum(many) - 1)[column[keep]]
    owner = owner[keep]
    out = np.zeros((n, n), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + 4096, 4096))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            m = np.zeros((n, column[b - 1] % 4096 + 1), np.float32)  # as wide as there are items: most groups have few
            m[owner[a:b], column[a:b] % 4096] = 1
            out += m @ m.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out.astype(np.int64)


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    common = intersections(sets)
    size = np.array([len(s) for s in sets])
    link = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    np.fill_diagonal(link, False)
    return link & (size[:, None] > 0) & (size[None, :] > 0)


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, a, b) of every two members of each group; members are numbered through all groups."""
    begins = np.cumsum(sizes) - sizes
    later = np.repeat(sizes, sizes) - 1 - (np.arange(int(sizes.sum())) - np.repeat(begins, sizes))  # members behind each in its group
    a = np.repeat(np.arange(len(later)), later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    return np.repeat(np.arange(len(sizes)), sizes)[a], a, b


def _common_of_pairs(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How much sets[a] and sets[b] have in common, for each pair, without a loop over pairs."""
    size = np.array([len(s) for s in sets], np.int64)
    items, number = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    have = np.repeat(np.arange(len(sets)), size) * len(items) + number  # sorted, as members and their items are
    begins = np.cumsum(size) - size
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), PAIRS):
        x, y = a[at : at + PAIRS], b[at : at + PAIRS]
        of = np.repeat(np.arange(len(x)), size[x])
        place = np.arange(len(of)) - np.repeat(np.cumsum(size[x]) - size[x], size[x]) + begins[x][of]
        asked = number[place] + y[of] * len(items)
        found = np.minimum(np.searchsorted(have, asked), max(0, len(have) - 1))
        out[at : at + PAIRS] = np.bincount(of, have[found] == asked, len(x)).astype(np.int64) if len(of) else 0
    return out


def verifier(threshold: float = THRESHOLD):
    """For rows i, j, members (mine, rid, weight, body): links of each member, and edges that join what is linked."""

    def links(sets: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) of the linked members: small groups together, others one by one."""
        n = np.array([len(s) for s in sets])
        small = sizes <= SMALL
        begins = np.cumsum(sizes) - sizes
        chosen = np.flatnonzero(np.repeat(small, sizes))
        _, a, b = _pairs(sizes[small])
        both = _common_of_pairs([sets[k] for k in chosen], a, b)
        a, b = chosen[a], chosen[b]
        link = (both >= threshold * (n[a] + n[b] - both) - 1e-9) & (n[a] > 0) & (n[b] > 0)
        found = [(a[link], b[link])]
        for at, size in zip(begins[~small], sizes[~small], strict=True):
            x, y = np.nonzero(np.triu(linked(sets[at : at + size], threshold)))
            found.append((x + at, y + at))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A few groups at a time: one row may hold two cells of texts."""
        for whole in batches:
            bodies = pc.fill_null(pc.binary_length(whole.column(2).flatten().field("body")), 0).to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(bodies)])
            counts = pc.fill_null(pc.list_value_length(whole.column(2)), 0).to_numpy(zero_copy_only=False)
            for at, n in parts_of(np.diff(before[np.concatenate([[0], np.cumsum(counts)])]), 2 * PART_BYTES):
                yield whole.slice(at, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            members = batch.column(2)
            flat = members.flatten()
            mine, rid, weight = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("mine", "rid", "weight"))
            group = np.repeat(np.arange(batch.num_rows), pc.list_value_length(members).to_numpy(zero_copy_only=False))
            order = np.lexsort((rid, group))
            new = np.concatenate([[True], (rid[order][1:] != rid[order][:-1]) | (group[order][1:] != group[order][:-1])]) if len(order) else np.zeros(0, bool)
            order = order[new]
            many = np.bincount(group[order], minlength=batch.num_rows)
            order = order[many[group[order]] > 1]
            mine, rid, weight, group = mine[order], rid[order], weight[order], group[order]
            a, b = links(shingle_sets(flat.field("body").take(pa.array(order))), many[many > 1])
            apart = (batch.column(0).to_numpy(zero_copy_only=False) != batch.column(1).to_numpy(zero_copy_only=False))[group[a]]
            counts = ~apart | (mine[a] != mine[b])  # pairs inside a cell are counted where it meets itself
            a, b = a[counts], b[counts]
            texts = np.bincount(np.concatenate([a, b]), minlength=len(rid))
            docs = np.bincount(np.concatenate([a, b]), np.concatenate([weight[b], weight[a]]), len(rid)).astype(np.int64)
            some = np.flatnonzero(texts)
            x, y = np.array(forest((a, b), len(rid)), np.int64).reshape(-1, 2).T
            nothing, none = np.zeros(len(x), np.int64), pa.nulls(len(some), pa.int64())
            columns = [np.concatenate([rid[some], rid[x]]), pa.concat_arrays([none, pa.array(rid[y], pa.int64())]), np.concatenate([texts[some], nothing]), np.concatenate([docs[some], nothing])]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], ["rid", "other", "texts", "docs"])

    return tidy(run), "rid long, other long, texts long, docs long"


def verified(members: DataFrame, group: str = "comp", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rid, texts, docs: counts of links) and (a, b: edges) of dealt members (rid, weight, body, k, mine) of candidate groups."""
    meet = meeting(members).groupBy(group, "i", "j").agg(F.collect_list(F.struct("mine", "rid", "weight", "body")).alias("members"))
    found = stash(meet.select("i", "j", "members").mapInArrow(*verifier(threshold)), "links")
    counts = found.filter("other IS NULL").groupBy("rid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    return counts, found.filter("other IS NOT NULL").select(F.col("rid").alias("a"), F.col("other").alias("b"))
