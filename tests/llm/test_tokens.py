"""Operators 5 and 9 against the tokenizers library."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weir.llm import bpe_codec, token_counts
from weir.llm.queries import vocabulary

from .common import awkward, clashing, empty

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def libs():
    return Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)


def check(texts, libs):
    word, byte = libs
    codec, counter = bpe_codec.codec(WORD), token_counts.counter(BYTE)
    want = [e.ids for e in word.encode_batch(texts, add_special_tokens=False)]
    assert [codec.encode(t) for t in texts] == want
    assert [codec.decode(ids) for ids in want] == [word.decode(ids, skip_special_tokens=False) for ids in want]
    assert counter.count(texts) == [len(e.ids) for e in byte.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text("ab ", max_size=60) | st.text("the<|endoftext|>startof ", max_size=60))
def test_any_text(t):
    check([t.encode("utf-8", "ignore").decode()], (Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)) if not hasattr(check, "libs") else check.libs)


check.libs = (Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE))


def test_special_strings_runs_and_long_words(libs):
    rng = random.Random(9)
    texts = ["", " ", "<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|>c", "<|endoftext", "a" * 5000, "abab" * 2000, "=" * 999, "\n" * 50 + "x", "1234567890" * 100, "日本語" * 300, "ΌΣΟΣ ΣΑΣ. ẞ ǅ İ", "x\u0085y\x1cz\u3000w"]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    check(texts, libs)


def test_backtracking_with_small_pair_tables(libs, monkeypatch):
    monkeypatch.setattr(bpe_codec, "PAIRS", 50)
    monkeypatch.setattr(bpe_codec, "CACHE", 20)
    monkeypatch.setattr(token_counts, "CACHE", 20)
    check(["unbelievable internationalization counterproductive " * 20, "qqqq zzzz xyxyxy" * 9], libs)


def test_queries_on_awkward_rows(spark, libs):
    docs = awkward(spark)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    word, byte = libs
    got = sorted((tuple(r) for r in token_counts.count_tokens(clashing(docs), BYTE).collect()), key=repr)
    want = []
    for i, t in texts:
        n = len(byte.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in texts:
        ids = word.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False))))
    assert sorted((tuple(r) for r in bpe_codec.digest_documents(clashing(docs), WORD).collect()), key=repr) == sorted(want, key=repr)
    ids = bpe_codec.encode_documents(docs.select("doc_id", "text"), WORD)
    back = {(r["doc_id"], r["text"]) for r in bpe_codec.decode_documents(ids, WORD).collect()}
    assert back == {(i, word.decode(word.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in texts}
    assert token_counts.count_tokens(empty(spark), BYTE).count() == 0 and bpe_codec.digest_documents(empty(spark), WORD).count() == 0


def test_codec_keeps_words_that_come_again(monkeypatch):
    monkeypatch.setattr(bpe_codec, "CACHE", 50)
    codec = bpe_codec.Codec(WORD)
    seen, encode = [], codec.encode_word
    codec.encode_word = lambda word: seen.append(word) or encode(word)
    rare = ["".join(chr(97 + int(d)) for d in str(1000 + i)) for i in range(400)]
    for i in range(0, 400, 5):
        codec.digest("again and again " + " ".join(rare[i : i + 5]))
    assert seen.count(b"again") == 1 and len(seen) == 402
    assert len(codec.known) <= 50 + 7 and len(codec.known.before) <= 50 + 7


def test_ids_alone_are_kept_packed_in_half_the_room(monkeypatch):
    monkeypatch.setattr(bpe_codec, "CACHE", 100)
    codec, plain = bpe_codec.Codec(WORD), bpe_codec.Codec(WORD)
    rare = ["".join(chr(97 + int(d)) for d in str(1000 + i)) for i in range(400)]
    for i in range(0, 400, 5):
        text = "again " + " ".join(rare[i : i + 5])
        assert codec.encode(text) == [x for word in text.split() for x in plain.encode_word(word.encode())]
    assert len(codec.known_ids) <= 50 + 6 and len(codec.known_ids.before) <= 50 + 6
    assert all(type(x) is bytes and len(x) == 4 * len(plain.encode_word(word.encode())) for word, x in codec.known_ids.items())


def test_codec_splits_as_the_splitter():
    pattern = bpe_codec.Words.PATTERN
    words, splitter = bpe_codec.Words(pattern), bpe_codec.Splitter(pattern)
    chars = [chr(i) for i in range(0x11000) if not 0xD800 <= i < 0xE000]
    for text in ["".join(f"a{c}{c} 1{c}'{c}" for c in chars[i : i + 64]) for i in range(0, len(chars), 64)] + ["it's we'll 'tis\x1cx\x85y", "a\U0001e4d0b \U00010d40"]:
        assert words(text) == splitter(text)
