"""Operator 6: SentencePiece models on the tokenizers library.

The model file (a protobuf) is parsed here: its normaliser, its metaspace marker, its pieces with their scores
(unigram models) or the merges that these scores imply (BPE models), and its byte pieces. Batches are encoded by
the library's threads. Every row is also encoded by the sentencepiece library itself, and the ids are compared.

Defined results: null and empty texts have no ids; a text decodes to its normalised form; texts of any length
are encoded whole; other columns are left aside.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from .common import give_back, small_batches, table, tidy
from .suffix_dedup import _hashes as span_hashes
from .suffix_dedup import _prefix as byte_prefix

#: Threads of the tokenizers library in a worker, which has a core of its own; more would burn time and hold memory.
os.environ.setdefault("RAYON_NUM_THREADS", "1")
SPACE = "▁"
MODEL = os.environ.get("INKWELL_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Fixed values of the model format: model types and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        shift = value = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[i : i + n]
            i += n


def parse_model(data: bytes) -> dict:
    out = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "prefix": True, "squeeze": True, "charsmap": b"", "name": ""}
    for field, value in _fields(data):
        if field == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            out["pieces"].append((piece, score, kind))
        elif field == 2:
            for k, v in _fields(value):
                if k == 3:
                    out["type"] = v
                elif k == 35:
                    out["byte_fallback"] = bool(v)
        elif field == 3:
            for k, v in _fields(value):
                if k in (1, 2, 3, 4):
                    out[{1: "name", 2: "charsmap", 3: "prefix", 4: "squeeze"}[k]] = v.decode() if k == 1 else v if k == 2 else bool(v)
    return out


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All pairs of pieces that make a piece, best score first."""
    rank = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    found = []
    for p, i in rank.items():
        for cut in range(1, len(p)):
            if p[:cut] in rank and p[cut:] in rank:
                found.append((-pieces[i][1], i, rank[p[:cut]], rank[p[cut:]], p[:cut], p[cut:]))
    return [(a, b) for *_, a, b in sorted(found)]


def build_tokenizer(model: dict) -> Tokenizer:
    pieces = model["pieces"]
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    if model["type"] == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in pieces], unknown, model["byte_fallback"])
    elif model["type"] == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, _merges(pieces), unk_token=pieces[unknown][0], byte_fallback=model["byte_fallback"], fuse_unk=True)
    else:
        raise ValueError(f"model type {model['type']} isn't supported")
    made = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["squeeze"]:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["prefix"]:
        steps.append(normalizers.Prepend(SPACE))
    made.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    inside = any(SPACE in p.lstrip(SPACE) for p, _, kind in pieces if kind in (NORMAL, USER))
    if model["type"] == BPE and not inside:  # no piece goes on over a marker, so that words can be encoded one by one
        made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    made.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model["prefix"] else [])])
    own = [AddedToken(p, normalized=False) for p, _, kind in pieces if kind == USER]
    if own:
        made.add_tokens(own)
    return made


class Codec:
    """A model's tokenizer, and the sentencepiece library's processor for the same file.

    Where no piece goes on over a metaspace marker, each marked word has the same ids in any text; distinct
    words are then encoded once, many to a string, and remembered in Arrow and numpy arrays, without Python objects. Of
    more than MEMO words or 8 * MEMO ids those that texts use most stay. Other models encode whole texts.
    A word stands without its marker where its text has one before each word and no other.
    """

    TOGETHER, BATCH, MEMO = 2000, 4, 250_000

    def __init__(self, data: bytes):
        import sentencepiece

        model = parse_model(data)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.tokenizer = build_tokenizer(model)
        self.by_word = self.tokenizer.pre_tokenizer is not None and not model["charsmap"] and not model["squeeze"] and all(p[2] != USER for p in model["pieces"])
        self.prefix = SPACE if model["prefix"] else ""
        self.marked = np.array([p.startswith(SPACE) for p, _, _ in model["pieces"]])  # of a word's pieces only the first is
        ascii_byte = {f"<0x{b:02X}>": chr(b) for b in range(128)}
        self.plain = pa.array([p.replace(SPACE, " ") if kind in (NORMAL, USER) else ascii_byte.get(p) if kind == BYTE else None for p, _, kind in model["pieces"]], pa.string())
        self._empty_memo()
        if self.by_word:  # words come with their markers
            self.tokenizer.normalizer = normalizers.Sequence([])

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, and for each word where its ids start and how many they are."""
        marked = pc.starts_with(words, SPACE)
        tails = pc.if_else(marked, pc.utf8_slice_codeunits(words, 1), words)
        apart = pc.or_(pc.equal(tails, ""), pc.starts_with(tails, SPACE))
        if not self.prefix:
            apart = pc.or_(apart, pc.invert(marked))
        apart = apart.to_numpy(zero_copy_only=False)
        alone, rest = np.flatnonzero(apart), np.flatnonzero(~apart)
        ends = [*range(0, len(rest), self.TOGETHER), len(rest)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tails.take(pa.array(rest)))
        texts = [words[i].as_py() for i in alone.tolist()] + [SPACE + t for t in pc.binary_join(lists, SPACE).to_pylist()]
        groups = [*alone[:, None], *np.split(rest, ends[1:-1])][: len(texts)]
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts, done = [np.zeros(0, np.int32)], 0
        for group, ids in zip(groups, self._encode_groups(texts), strict=True):
            first = np.flatnonzero(self.marked[ids]) if len(group) > 1 else np.zeros(1, np.int64)
            if len(first) != len(group) or len(ids) and first[0]:
                raise ValueError("a word was split otherwise than alone")
            start[group], size[group] = done + first, np.diff(np.append(first, len(ids)))
            parts.append(ids)
            done += len(ids)
        return np.concatenate(parts), start, size

    def _encode_groups(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, BATCH texts at a time: the library's results are large."""
        for at in range(0, len(texts), self.BATCH):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + self.BATCH], add_special_tokens=False):
                yield np.array(e.ids, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids if t else [], np.int32) for e, t in zip(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), texts, strict=True)]
        offsets, words = self._split_all(texts)
        at = self._places(words)
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])[offsets]
        return np.split(self.ids[_ranges(self.start[at], size)], ends[1:-1]) if texts else []

    def _places(self, words: pa.Array) -> np.ndarray:
        """The place of each word in the memo, which the new ones join."""
        if len(self.words) > self.MEMO or len(self.ids) > 8 * self.MEMO:
            self._trim_memo()
        kinds = words.dictionary_encode()
        keys = _word_keys(kinds.dictionary)
        place = self._known(kinds.dictionary, keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.words) + np.arange(len(new))
            added = kinds.dictionary.take(pa.array(new))
            ids, start, size = self._encode_words(added)
            self.start = np.concatenate([self.start, start + len(self.ids)])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, ids])
            self.words = pa.concat_arrays([self.words, added])
            order = np.argsort(keys[new])
            at = np.searchsorted(self.keys, keys[new][order])
            self.keys = np.insert(self.keys, at, keys[new][order])
            self.places = np.insert(self.places, at, place[new][order])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        chosen = kinds.indices.to_numpy()
        self.uses[place] += np.bincount(chosen, minlength=len(place))
        return place[chosen]

    def _known(self, words: pa.Array, keys: np.ndarray) -> np.ndarray:
        """The place of each word in the memo, -1 if it isn't there: found by its hash, and compared."""
        if not len(self.keys):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        place = self.places[at].astype(np.int64)
        hit = np.flatnonzero(self.keys[at] == keys)
        same = pc.equal(words.take(pa.array(hit)), self.words.take(pa.array(place[hit]))).to_numpy(zero_copy_only=False)
        found = np.full(len(words), -1, np.int64)
        found[hit[same]] = place[hit[same]]
        return found

    def _split_all(self, texts: list[str]) -> tuple[np.ndarray, pa.Array]:
        """Where each text's words start, and the words of all texts. Arrow splits the plain ones, without Python objects."""
        plain = [bool(self.prefix) and bool(t) and "  " not in t and SPACE not in t and t[0] != " " and t[-1] != " " for t in texts]
        parts = pc.split_pattern(pa.array([t if p else None for t, p in zip(texts, plain, strict=True)], pa.string()), " ")
        counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = parts.flatten()
        rest = {i: w for i, p in enumerate(plain) if not p and (w := self._split(texts[i]))}
        if rest:
            ends = np.cumsum(counts)
            pieces, done = [], 0
            for i, w in rest.items():
                pieces += [words.slice(done, ends[i] - done), pa.array(w, pa.string())]
                done, counts[i] = ends[i], len(w)
            words = pa.concat_arrays([*pieces, words.slice(done)])
        return np.concatenate([[0], np.cumsum(counts)]), words

    def _empty_memo(self) -> None:
        """Words of the batches so far, how often they were used, and where the ids of each start and how many they are; their
        hashes in order, and whose they are, so that a batch's words are looked up without hashing the memo again."""
        self.words = pa.array([], pa.string())
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.uses, self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _trim_memo(self) -> None:
        """Leaves the words that are used most, half of what the memo may hold; earlier uses count half from then on."""
        order = np.argsort(-self.uses, kind="stable")[: self.MEMO // 2]
        kept = np.sort(order[np.cumsum(self.size[order]) <= 4 * self.MEMO])
        self.words, self.uses, start, self.size = self.words.take(pa.array(kept)), self.uses[kept] // 2, self.start[kept], self.size[kept]
        self.ids = self.ids[_ranges(start, self.size)]
        self.start = np.cumsum(self.size) - self.size
        left = np.full(int(self.places.max(initial=-1)) + 1, -1, np.int32)
        left[kept] = np.arange(len(kept))
        stay = left[self.places] >= 0
        self.keys, self.places = self.keys[stay], left[self.places[stay]]

    def _split(self, text: str) -> list[str]:
        """The words of a text with their markers."""
        return _MARKED.findall(self.prefix + text.replace(" ", SPACE)) if text else []

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Pieces joined, markers as blanks; texts with other bytes than ASCII, control or unknown pieces go to the library."""
        ends = np.cumsum([0, *map(len, ids)])
        out: list[str] = []
        for a, b in _cuts(ends[1:], 1_000_000):  # as many ids at a time
            pieces = self.plain.take(pa.array(np.concatenate(ids[a:b]), pa.int32()))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - ends[a], pa.int32()), pieces), "").to_pylist()
            for own, text in zip(ids[a:b], texts, strict=True):
                if text is None:
                    out.append(self.tokenizer.decode(own.tolist(), skip_special_tokens=False))
                else:
                    out.append(text[1:] if self.prefix and text[:1] == " " else text)
        return out


def _word_keys(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words."""
    _, offsets, data = words.buffers()
    edges = np.frombuffer(offsets, np.int32, len(words) + 1, words.offset * 4).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    flat = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    return span_hashes(byte_prefix(flat, 0), 0, edges[:-1], edges[1:]) ^ np.diff(edges).astype(np.uint64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, on end."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _cuts(total: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Rows from and to, of about `size` together: total is the running sum of their sizes."""
    at = 0
    while at < len(total):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + size, "right")))
        yield at, end
        at = end


def _parts(batch: pa.RecordBatch, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices with about so many bytes of text, in column 1."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    for at, end in _cuts(total, size):
        yield batch.slice(at, end - at)


_MARKED = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(2)
def _loaded(name: str) -> Codec:
    path = name if os.path.exists(name) else SparkFiles.get(os.path.basename(name))
    with open(path, "rb") as f:
        return Codec(f.read())


def _forget() -> None:
    _loaded.cache_clear()


def encode_texts(name: str, texts: list[str]) -> list[np.ndarray]:
    return _loaded(name).encode(texts)


def decode_ids(name: str, ids: list[np.ndarray]) -> list[str]:
    return _loaded(name).decode(ids)


_FACTS = {"n_ids": pa.int64(), "ids_sha256": pa.string(), "round_trip": pa.bool_(), "parity": pa.bool_()}
_FACTS_SQL = "n_ids long, ids_sha256 string, round_trip boolean, parity boolean"


def _digests(name: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded(name).own
        for whole in batches:
            for batch in _parts(whole):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids = encode_texts(name, texts)
                back = decode_ids(name, ids)
                same = own.encode(texts, num_threads=1, return_type="numpy")
                normal = own.normalize(texts)
                rows = [
                    (len(i), hashlib.sha256(i.astype("<u4").tobytes()).hexdigest(), b == n.replace(SPACE, " ").removeprefix(" "), np.array_equal(i, s))
                    for i, b, n, s in zip(ids, back, normal, same, strict=True)
                ]
                columns = [batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FACTS.values(), strict=True))]
                if with_ids:
                    columns.append(_lists(ids))
                del texts, ids, back, same, normal, rows
                give_back()
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_FACTS, *["ids"] * with_ids])

    return tidy(run, _forget)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids (array of int)."""
    _ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole):
                ids = encode_texts(model, [t or "" for t in batch.column(1).to_pylist()])
                give_back()
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), _lists(ids)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run, _forget), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of the rows of encode_documents."""
    _ship(encoded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = decode_ids(model, [np.array(i or [], np.int64) for i in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run, _forget), "doc_id long, text string")


def _ship(spark: SparkSession, model: str) -> None:
    """Executors that don't have the model at the same path get it from the driver."""
    small_batches(spark)
    spark.sparkContext.addFile(model)


def digest_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_ids, ids_sha256, round_trip (decodes to its normalised form) and parity (the library has the same ids)."""
    _ship(docs.sparkSession, model)
    return docs.select("doc_id", "text").mapInArrow(_digests(model, False), f"doc_id long, {_FACTS_SQL}")


def encode_checked(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The columns of digest_documents, and the ids."""
    _ship(docs.sparkSession, model)
    return docs.select("doc_id", "text").mapInArrow(_digests(model, True), f"doc_id long, {_FACTS_SQL}, ids array<int>")


def op6_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
