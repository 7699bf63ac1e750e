"""Operator 7: the main text of web pages, with a sparse suffix array over each host's token streams.

Markup is read in one pass. Elements that hold no article text by their tag, role or class are left out. If a page
marks its article (article, or names such as post-content) or else its main part, only the blocks in it go on; of
other pages all blocks do. These blocks are the page's token stream; block ends are tokens that no run crosses.

The host's suffix array. Of each stream the suffixes that start a block, and those at sampled places (the least hash of
successive 4-grams, so that equal runs are sampled alike) are dealt to buckets by their first tokens: the whole block,
or those of DEPTHS. Any run of RUN tokens (depth + step - 1) has a sampled place, so that buckets of one page hold nothing
that repeats. Around the places in the other buckets every suffix is taken, sampled or not, and put in order by its first
RUN tokens: one with a neighbour of another page there begins a run, and successive ones of these make a maximal run.
No run of RUN tokens or more is missed, in buckets of any size; shorter ones count only as whole blocks. Blocks of fewer
than LONG tokens and others are compared among themselves.

A block is boilerplate if runs that repeat on distinct pages cover COVERED of it: on two pages if it is short, on three
if it has QUOTED tokens or more, as two pages may quote or copy one text. Boilerplate goes, all else stays whole: a
quotation inside a paragraph is no boilerplate. The marks of an article are a hint that its blocks are text: there it
takes COMMON of the host's pages to make a block boilerplate, and an article that repeats for the most part stays.

Defined results: null and empty html give an empty text; markup that is cut off ends with the page; br counts as
white space; pages of one host with equal blocks are one page, so that copies don't turn each other into boilerplate;
pages without a host form a group; repeated rows get one row each, alike; very long pages are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table, tidy
from .near import forget, gram_hashes, window_starts, word_hashes
from .suffix_dedup import _hashes as span_hashes
from .suffix_dedup import _mix as mix
from .suffix_dedup import _power

GRAM = 4
LONG = 64
#: (tokens that name a bucket, places of which one is sampled) in blocks of fewer than LONG tokens, and of others.
DEPTHS = ((6, 7), (12, 13))
COVERED = 0.8
QUOTED = 30
#: Suffixes with equal first tokens above which they are dealt to SALTS tasks.
CELL, SALTS = 1000, 32
#: Places of boilerplate up to which they are sent to all executors (about 40 bytes each); beyond, the pages' blocks are shuffled to them.
SEND_PLACES = 200_000
COMMON, COMMON_LEAST = 0.3, 5
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "object", "math")}
AWAY = {"head", "nav", "footer", "aside", "form", "button", "menu", "dialog", "label", "fieldset", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|promotion|banner|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|"
    r"footer|masthead|site-header|page-header|comments?|comment-list|replies|respond|disqus|cookies?|consent|notice|notification|alert|popup|modal|overlay|"
    r"share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|search|widget|toolbar|pagination|pager|skip-link)(?:$|[\s_-])",
    re.I,
)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|topbar|top-bar|copyright|legal|imprint)(?:$|[\s_-])", re.I)
ARTICLE_NAMES = re.compile(r"(?:^|\s)(?:article|articlebody|article-body|article-content|post|post-body|post-content|entry|entry-content|story|story-body|blog-post|news-text)(?:$|\s)", re.I)
MAIN_NAMES = re.compile(r"(?:^|\s)(?:main|main-content|content|page-content|maincontent|body-content)(?:$|\s)", re.I)
UNLIKELY = {"nav", "header", "form", "menu"}
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}


def _away(tag: str, attributes: str, inside: bool) -> bool:
    if tag in AWAY or tag == "header" and not inside:
        return True
    if not attributes.strip():
        return False
    if "hidden" in re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*'|\S+)", "", attributes).split():
        return True
    if tag in ("html", "body", "article", "main") and "comment" not in attributes:
        return False
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if values.get("role", "").lower() in ROLES or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", "")):
        return True
    names = [values[k] for k in ("class", "id") if k in values]
    return any(NAMES.search(n) or not inside and HEADER_NAMES.search(n) for n in names)


def _level(tag: str, attributes: str) -> int:
    """2 of an element that is an article, 1 of one that is a page's main part, else 0."""
    if tag == "article":
        return 2
    if tag == "main":
        return 1
    if tag not in ("div", "section", "td") or "=" not in attributes:
        return 0
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = f"{values.get('class', '')} {values.get('id', '')} {values.get('itemprop', '')}"
    return 2 if ARTICLE_NAMES.search(names) else 1 if values.get("role") == "main" or MAIN_NAMES.search(names) else 0


def blocks_of(page: str | None) -> tuple[list[str], bool]:
    """The page's blocks of text, and whether the page marks them as its article."""
    page = page or ""
    found: tuple[list[str], list[str], list[str]] = ([], [], [])  # all blocks, those of the main part, those of articles
    text: list[str] = []
    marks: list[list] = []  # tag, how many of its name are open, and level of the marked elements that are open
    gone, depth = "", 0  # the element that is left out, and how many of its name are open
    at = 0

    def end_block() -> None:
        joined = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if joined:
            best = max((m[2] for m in marks), default=0)
            for level in range(best + 1):
                found[level].append(joined)

    while True:
        m = TAG.search(page, at)
        if not gone:
            text.append(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        close, attributes = m[1], m[3]
        if tag in RAW and not close:
            end = RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if gone in UNLIKELY and tag in ("article", "main") and not close:
            gone = ""  # its end tag is missing
        if gone:
            if tag == gone:
                depth += -1 if close else 0 if attributes.endswith("/") else 1
                if depth <= 0:
                    gone = ""
            continue
        if tag in BLOCK or tag in AWAY:
            end_block()
        elif tag == "br":
            text.append(" ")
        if tag in VOID or attributes.endswith("/"):
            continue
        if close:
            for k in range(len(marks) - 1, -1, -1):
                if marks[k][0] == tag:
                    marks[k][1] -= 1
                    if marks[k][1] <= 0:
                        del marks[k]
                    break
            continue
        if _away(tag, attributes, any(x[2] == 2 for x in marks)):
            gone, depth = tag, 1
            continue
        level = _level(tag, attributes)
        if level:
            marks.append([tag, 1, level])
        else:
            mine = next((x for x in reversed(marks) if x[0] == tag), None)
            if mine:
                mine[1] += 1
    end_block()
    return next(((blocks, True) for blocks in (found[2], found[1]) if blocks), (found[0], False))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, key (of the page), packed to h (bucket), host, key, block, place (-1: the whole block)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            host, key, packed = whole.slice(at, 200).columns
            yield _suffixes(host.to_numpy(zero_copy_only=False), key.to_numpy(zero_copy_only=False), [_unpacked(x) for x in packed.to_pylist()])


def _key(host: int, blocks: list[str], marked: bool) -> int:
    """Of a page's stream; odd if its article is marked."""
    found = xxhash.xxh3_64_intdigest("\n".join(blocks).encode("utf-8", "surrogatepass"), host & 0xFFFFFFFFFFFFFFFF)
    return (found & ~1 | marked) - (1 << 63)


def _suffixes(hosts: np.ndarray, keys: np.ndarray, pages: list[list[str]]) -> pa.RecordBatch:
    tokens = [b.split(" ") for x in pages for b in x]
    size = np.array([len(t) for t in tokens], np.int64)
    page = np.repeat(np.arange(len(pages)), [len(x) for x in pages])
    block = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in pages)])
    host = hosts.astype(np.int64)[page]
    words = word_hashes([w for t in tokens for w in t])
    ends = np.cumsum(size)
    begins = ends - size
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(2, len(words)), out=prefix[1:])
    found = [(span_hashes(prefix, 0, begins, ends) ^ np.uint64(1), np.arange(len(size)), np.full(len(size), -1))]
    grams = gram_hashes(words, GRAM)
    for k, (depth, step) in enumerate(DEPTHS):
        start = window_starts(grams, begins, ends, depth, step)
        of = np.searchsorted(ends, start, "right")
        own = (size[of] >= LONG) == bool(k)
        start, of = start[own], of[own]
        found.append((span_hashes(prefix, 0, start, start + depth) ^ np.uint64(depth), of, start - begins[of]))
    h, of, place = (np.concatenate(x) for x in zip(*found, strict=True))
    h = mix(h ^ host[of].astype(np.uint64)).astype(np.int64)
    columns = [pa.array(h), pa.array(host[of]), pa.array(keys[page[of]]), pa.array(block[of].astype(np.int32)), pa.array(place.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["h", "host", "key", "block", "place"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, host, html to host, key, page_id, url, marked, packed (the blocks, compressed)."""
    made = zstandard.ZstdCompressor(level=9)
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            batch = whole.slice(at, 200)
            keys, marked, packed = [], [], []
            for host, page in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                blocks, sure = blocks_of(page)
                keys.append(_key(host, blocks, sure))
                marked.append(sure)
                packed.append(made.compress("\n".join(blocks).encode("utf-8", "surrogatepass")))
            columns = [batch.column(2), pa.array(keys, pa.int64()), batch.column(0), batch.column(1), pa.array(marked), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "key", "page_id", "url", "marked", "packed"])


def _unpacked(packed: bytes) -> list[str]:
    text = zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")
    return text.split("\n") if text else []


def _run(block_size: int) -> int:
    """RUN of a block."""
    return sum(DEPTHS[block_size >= LONG]) - 1


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, key, packed, hits to h, host, key, block, place: all suffixes whose first RUN tokens hold a hit's; whole blocks as they are."""
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            batch = whole.slice(at, 200)
            found: list[tuple[np.ndarray, ...]] = []
            for host, key, packed, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places: dict[int, list[int]] = defaultdict(list)
                for x in hits:
                    if x["place"] < 0:
                        found.append(tuple(np.array([v], np.int64) for v in (x["h"], host, key, x["block"], -1)))
                    else:
                        places[x["block"]].append(x["place"])
                blocks = _unpacked(packed) if places else []
                for k, own in places.items():
                    words = word_hashes(blocks[k].split(" "))
                    run, step = _run(len(words)), DEPTHS[len(words) >= LONG][1]
                    start = np.unique(np.add.outer(np.array(own, np.int64), -np.arange(step)))
                    start = start[(start >= 0) & (start + run <= len(words))]
                    prefix = np.zeros(len(words) + 1, np.uint64)
                    np.cumsum(words * _power(2, len(words)), out=prefix[1:])
                    h = mix(span_hashes(prefix, 0, start, start + run) ^ np.uint64(run) ^ np.int64(host).astype(np.uint64)).astype(np.int64)
                    found.append((h, *(np.full(len(start), v, np.int64) for v in (host, key, k)), start))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds, strict=True)], ["h", "host", "key", "block", "place"])


def kept_blocks(blocks: list[str], marked: bool, hits: list[dict]) -> list[str]:
    """The blocks without boilerplate. hits: block, place (-1: whole; else of RUN tokens that repeat), n (distinct pages)."""
    if not hits:
        return blocks
    size = [b.count(" ") + 1 for b in blocks]
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    pages: dict[int, int] = {}
    for x in hits:
        k, at = x["block"], x["place"]
        runs[k].append((0, size[k]) if at < 0 else (at, at + _run(size[k])))
        pages[k] = max(pages.get(k, 0), x["n"])
    share = {}
    for k, own in runs.items():
        end = total = 0
        for a, b in sorted(own):
            total += max(0, b - max(a, end))
            end = max(end, b)
        share[k] = total / size[k]
    if marked and sum(share[k] * size[k] for k in share) >= 0.5 * sum(size):
        return blocks
    gone = {k for k, s in share.items() if s >= COVERED and pages[k] >= (3 if size[k] >= QUOTED else 2)}
    return [b for k, b in enumerate(blocks) if k not in gone]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n".join(kept_blocks(_unpacked(packed), marked, hits or [])) for marked, packed, hits in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _repeated(suffixes: DataFrame, hosts: DataFrame) -> DataFrame:
    """_key, block, place, n (distinct pages) of suffixes (h, host, key, block, place) with an equal of another page that counts for theirs."""
    each = suffixes.groupBy("h", "key").agg(F.count(F.lit(1)).alias("size"), F.min("host").alias("host"))
    equal = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("host").alias("host")).filter("n > 1")
    equal = equal.join(hosts, F.col("host") == F.col("_host"))
    common = (F.col("size") >= COMMON * F.col("pages")) & (F.col("n") >= COMMON_LEAST)
    equal = stash(equal.select(F.col("h").alias("_h"), "n", "size", common.alias("common")), "equal")
    hot = equal.filter(F.col("size") > CELL).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = suffixes.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    names = ["key", "block", "place", "n", "common"]
    few = suffixes.join(equal.filter(F.col("size") <= CELL), F.col("h") == F.col("_h")).select(names)
    many = salted.join(hot, (F.col("h") == F.col("_h")) & (F.col("salt") == F.col("_salt"))).select(names)
    return few.unionByName(many).filter(F.col("common") | (F.col("key").bitwiseAND(1) == 0)).select(F.col("key").alias("_key"), "block", "place", "n")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", r"^\w+://([^/:?#]*)", 1), F.lit(""))))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    packed = stash(own.mapInArrow(tidy(_packed), "host long, key long, page_id long, url string, marked boolean, packed binary"), "blocks")
    hosts = packed.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("pages"))

    suffixes = packed.select("host", "key", "packed").mapInArrow(tidy(_sampled, forget), "h long, host long, key long, block int, place int")
    unmarked = F.min(F.col("key").bitwiseAND(1)) == 0
    short = F.col("h").bitwiseAND((1 << 40) - 1)  # buckets may hold others too, as what is in them is compared again
    buckets = suffixes.groupBy(short.alias("_h")).agg((F.min("key") < F.max("key")).alias("many"), unmarked.alias("unmarked"), F.count(F.lit(1)).alias("size"), F.min("host").alias("host"))
    buckets = buckets.filter("many").join(hosts, F.col("host") == F.col("_host"))
    # marked pages alone need as many equal suffixes as make what is in them common
    buckets = buckets.filter(F.col("unmarked") | (F.col("size") >= F.greatest(COMMON * F.col("pages"), F.lit(COMMON_LEAST))))
    buckets = stash(buckets.select("_h"), "buckets")
    hits = suffixes.drop("host").join(buckets, short == F.col("_h"))
    hits = hits.groupBy(F.col("key").alias("_key")).agg(F.collect_set(F.struct("h", "block", "place")).alias("hits"))

    asked = packed.join(hits, F.col("key") == F.col("_key")).select("host", "key", "packed", "hits")
    around = stash(asked.mapInArrow(tidy(_around, forget), "h long, host long, key long, block int, place int"), "suffixes")
    repeats = stash(_repeated(around, hosts).groupBy("_key").agg(F.collect_set(F.struct("block", "place", "n")).alias("hits")), "repeats")
    places = repeats.agg(F.sum(F.size("hits"))).first()[0] or 0

    found = packed.join(F.broadcast(repeats) if places <= SEND_PLACES else repeats, F.col("key") == F.col("_key"), "left").select("page_id", "url", "marked", "packed", "hits")
    return found.mapInArrow(_kept, "page_id long, url string, text string").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
