"""Operator 6: distinct words are encoded once a memo."""

import tracemalloc

import numpy as np
import pyarrow as pa

from inkwell.llm import sentence_piece as s


def test_words_of_many_texts_are_encoded_once(monkeypatch):
    codec = s._loaded(s.MODEL)
    codec._empty_memo()
    texts = [" ".join(f"w{i}x{k}" for i in range(1000)) for k in range(150)]
    first = [codec.encode([t])[0] for t in texts]
    asked = []
    whole = codec._encode_words
    monkeypatch.setattr(codec, "_encode_words", lambda words: asked.append(len(words)) or whole(words))
    again = [codec.encode([t])[0] for t in texts]
    codec._empty_memo()
    assert not asked and all(map(np.array_equal, first, again))
    assert all(map(np.array_equal, first, codec.own.encode(texts, num_threads=1, return_type="numpy")))


def test_the_memo_holds_few_bytes_a_word():
    codec = s._loaded(s.MODEL)
    codec._empty_memo()
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    for k in range(20):
        codec.encode([" ".join(f"w{i}x{k}" for i in range(5000))])
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    codec._empty_memo()
    assert held < 100 * 100_000


def test_a_full_memo_keeps_the_words_that_are_used_most(monkeypatch):
    codec = s._loaded(s.MODEL)
    codec._empty_memo()
    monkeypatch.setattr(codec, "MEMO", 2000)
    often = " ".join(f"often{i}" for i in range(500))
    texts = [f"{often} {' '.join(f'w{i}x{k}' for i in range(900))}" for k in range(12)]
    asked = []
    whole = codec._encode_words
    monkeypatch.setattr(codec, "_encode_words", lambda words: asked.append(len(words)) or whole(words))
    got = [codec.encode([t])[0] for t in texts]
    codec._empty_memo()
    assert asked == [1400] + [900] * 11
    assert all(map(np.array_equal, got, codec.own.encode(texts, num_threads=1, return_type="numpy")))


def test_words_with_odd_markers_and_pieces_of_all_kinds():
    codec = s._loaded(s.MODEL)
    codec._empty_memo()
    texts = ["", " ", "  a  b ", "a▁b", "▁", "▁▁x y", "x ", " x", "tab\tnew\n line", "é 日本 \x00 ​", "a" * 3000, "🙂 🙂", " ".join(f"v{i}" for i in range(4500)), "x"]
    ids = codec.encode(texts)
    assert all(map(np.array_equal, ids, codec.own.encode(texts, num_threads=1, return_type="numpy")))
    assert codec.decode(ids) == [t.replace("▁", " ") for t in texts]
    assert codec.decode([]) == [] and codec.encode([]) == []
    odd = [np.array([i], np.int32) for i in range(300)]
    assert codec.decode(odd)[3:] == [codec.tokenizer.decode(o.tolist(), skip_special_tokens=False) for o in odd][3:]


def test_the_memo_is_not_hashed_again_for_each_batch(monkeypatch):
    """A batch's words are looked up; words of one hash are told apart, also in a memo that was trimmed."""
    codec = s._loaded(s.MODEL)
    codec._empty_memo()
    codec.encode([" ".join(f"w{i}" for i in range(20000))])
    joined = []
    whole = s.pa.concat_arrays
    monkeypatch.setattr(s.pa, "concat_arrays", lambda parts: joined.append(sum(map(len, parts))) or whole(parts))
    codec.encode([" ".join(f"w{i}" for i in range(100))])
    assert not joined
    monkeypatch.undo()
    codec._empty_memo()
    monkeypatch.setattr(codec, "MEMO", 300)
    monkeypatch.setattr(s, "_word_keys", lambda words: np.array([len(w.as_py()) for w in words], np.uint64))
    texts = [" ".join(f"a{(i * k) % 90}b{i % 7}" for i in range(120)) for k in range(1, 12)] + ["", "▁ ▁x", "  a"]
    got = [codec.encode([t])[0] for t in texts]
    codec._empty_memo()
    assert all(map(np.array_equal, got, codec.own.encode(texts, num_threads=1, return_type="numpy")))
