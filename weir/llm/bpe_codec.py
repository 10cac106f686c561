"""Operator 9, BPE encoding and decoding: a backtracking encoder and an offset table.

A word is a string over 512 symbols: its bytes, the last one in its word-end form. An Aho-Corasick automaton
over all tokens, run once over the word, gives the longest token at each place; the encoder takes it, and where
it isn't compatible with the token before, falls back to the next shorter token there, or drops the token before
and goes on from that one. Two neighbours are compatible if merging by rank would leave the border between them
alone, which is read off the way both tokens are built; answers go to a pair-compatibility table. Places that
can't be reached are marked, so a word takes linear time. The token ids are exactly those of merging by rank.

Decoding slices one byte buffer with an offset table. There is no shuffle; a worker keeps a bounded cache of
encoded words, from which words that come again don't go when it is full.

Cases: null text counts as empty (no tokens, and the hashes of the empty string); special strings inside a text
are one token each, as the library's default has them; repeated rows give equal rows; other columns are not
read; an empty table gives an empty table. Very long words (no white space) take linear time.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import KEPT, map_column, text_rows
from .token_counts import Splitter, byte_symbols

CACHE = 200_000  # words whose written ids a worker keeps (see Kept); half as many where it keeps ids alone, as beside other stages
LONGEST = 64  # characters of a word that is kept
PAIRS = 150_000  # entries that the pair-compatibility table keeps
END = 0x1000  # added to a byte's code: that byte at a word's end


class Kept(dict):
    """What `learn` says of the keys asked for last: a share of CACHE of them at least, twice as many at most (but for one text's)."""

    def __init__(self, learn: Callable, share: float = 1):
        self.learn, self.before, self.share = learn, {}, share

    def __missing__(self, key: str | int):
        out = self.before.get(key) or self.learn(key)
        if isinstance(key, int) or len(key) <= LONGEST:
            self[key] = out
        return out

    def turn(self) -> None:
        if len(self) > CACHE * self.share:
            self.before = dict(self)
            self.clear()


class Words:
    """A Splitter by the standard library's patterns, which take half the time: its classes are read off the splitter, for one plane of
    characters. Texts with others go to the splitter itself."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, pattern: str):
        self.any = Splitter(pattern)
        self.plane = None
        if pattern != self.PATTERN:
            return
        chars, split = [chr(i) for i in (*range(0xD800), *range(0xE000, 0x10000))], self.any.exact
        spaces = [c for c in chars if not split(c)]
        letters = [c for c in chars if len(split("a" + c)) == 1 and split(c)]
        numbers = [c for c in chars if len(split(c + c)) == 2]
        spaces, letters, numbers = ("".join(map(re.escape, x)) for x in (spaces, letters, numbers))
        self.plane = re.compile(f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{spaces}{letters}{numbers}]+").findall
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search

    def __call__(self, text: str) -> list[str]:
        return self.any(text) if self.plane is None or not text.isascii() and self.beyond(text) else self.plane(text)


class Codec:
    """Encoder and decoder of one vocabulary file with word ends."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or not self.suffix or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("lower-casing BPE vocabularies with word ends are supported")
        self.vocab, byte_of = model["vocab"], byte_symbols()
        self.words = Words(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        # tokens as strings over the 512 symbols
        def own(token: str) -> str:
            ends = token.endswith(self.suffix)
            codes = [byte_of[c] for c in (token[: -len(self.suffix)] if ends else token)]
            if ends:
                codes[-1] += END
            return "".join(map(chr, codes))

        texts = {i: own(t) for t, i in self.vocab.items() if i not in self.special.values()}
        # how each token is built: the first merge that makes it; the order of merges is the order of ids
        self.left, self.right, self.pair_id = {}, {}, {}
        rank_of: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if (x, y) not in self.pair_id:
                self.pair_id[x, y] = (rank, z)
            if z not in rank_of:
                rank_of[z], self.left[z], self.right[z] = rank, x, y
        self.rank = rank_of
        self.size_of, self.compatible_pairs = {i: len(t) for i, t in texts.items()}, {}
        # a token is in some result only if merging by rank leaves it whole: both its parts and their border's history
        reachable = {i for i, t in texts.items() if len(t) == 1}
        for z in sorted(rank_of, key=rank_of.__getitem__):
            if self.left[z] in reachable and self.right[z] in reachable and self._border_stands(self.left[z], self.right[z], rank_of[z]):
                reachable.add(z)
        self.automaton = ahocorasick.Automaton()
        for i in reachable:
            self.automaton.add_word(texts[i], (i, len(texts[i])))
        self.automaton.make_automaton()
        self.id_of = {texts[i]: i for i in reachable}
        # next shorter token that starts a token
        self.shorter: dict[int, int] = {}
        for i in reachable:
            t = texts[i]
            self.shorter[i] = next((self.id_of[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.id_of), -1)
        # the offset table of the decoder: token texts as the vocabulary writes them
        raw = [b""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in [*self.vocab.items(), *self.special.items()]:
            raw[i] = t.encode()
        self.buffer, self.offsets = b"".join(raw), np.cumsum([0, *map(len, raw)]).tolist()
        self.known = Kept(lambda word: self._written(self._ids(word)))
        self.known_ids = Kept(lambda word: np.array(self._ids(word), np.int32).tobytes(), 0.5)

    def _border_stands(self, x: int, y: int, gone: int) -> bool:
        """Tokens x and y, next to each other until merge `gone`, keep their border till then.

        Both are taken apart at the border, the one built last first: so each step has the parts that touched
        at one time of merging by rank. A pair of them that merges before one of them is swallowed would have
        closed the border; with equal ranks the leftmost place comes first, which closes it only from the left.
        """
        gone_x = gone_y = gone
        while True:
            rank, made = self.pair_id.get((x, y), (0, -1))
            if made >= 0 and rank < gone_x and rank <= gone_y:
                return False
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            if rx >= ry:
                gone_x, x = rx, self.right[x]
            else:
                gone_y, y = ry, self.left[y]

    def compatible(self, a: int, b: int) -> bool:
        """Merging by rank leaves the border between tokens a and b alone; answers are kept in the pair table."""
        fine = self.compatible_pairs.get(a << 32 | b)
        if fine is None:
            if len(self.compatible_pairs) > PAIRS:
                self.compatible_pairs.clear()
            fine = self.compatible_pairs[a << 32 | b] = self._border_stands(a, b, 1 << 60)
        return fine

    def encode_word(self, word: bytes) -> list[int]:
        s = word[:-1].decode("latin-1") + chr(word[-1] + END)
        if (whole := self.id_of.get(s)) is not None:
            return [whole]
        n = len(s)
        longest = [-1] * n
        for end, (i, size) in self.automaton.iter(s):  # by ends, so that the longest token at a place comes last
            longest[end - size + 1] = i
        size_of, shorter, fine = self.size_of, self.shorter, self.compatible_pairs.get
        out: list[int] = []
        dead = bytearray(n + 1)  # places from which the rest can't be encoded
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + size_of[token]
                if not dead[end]:
                    if last < 0:
                        break
                    known = fine(last << 32 | token)
                    if self.compatible(last, token) if known is None else known:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= size_of[token]
                token = shorter[token]
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        """As the library with no decoder set: token texts joined by one space, special tokens included."""
        buffer, at = self.buffer, self.offsets
        return b" ".join([buffer[at[i] : at[i + 1]] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode()

    def normalize(self, text: str) -> str:
        """NFC and lower case by character (a capital sigma has one lower form wherever it stands)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def pieces(self, text: str) -> list:
        """Words (str) and special ids (int), in order. White space only separates words."""
        if self.find_special is None or not self.find_special.search(text):
            return self.words(self.normalize(text))
        out: list = []
        for part in self.find_special.split(text):
            out += [self.special[part]] if part in self.special else self.words(self.normalize(part))
        return out

    def _ids(self, piece: str | int) -> list[int]:
        return [piece] if isinstance(piece, int) else self.encode_word(piece.encode())

    def _written(self, ids: list[int]) -> tuple[str, bytes]:
        return " ".join(map(str, ids)), self.decode_bytes(ids)

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit numbers, side by side."""
        out = b"".join(map(self.known_ids.__getitem__, self.pieces(text)))
        self.known_ids.turn()
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and the hashes of the written ids and of the decoded text."""
        found = list(map(self.known.__getitem__, self.pieces(text)))
        self.known.turn()
        if not found:
            return 0, EMPTY, EMPTY
        written, raw = zip(*found, strict=True)
        ids = " ".join(written)
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b" ".join(raw)).hexdigest()


EMPTY = hashlib.sha256(b"").hexdigest()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    KEPT[__name__] = codec.cache_clear
    return Codec(path)


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with token ids (array<int>) in place of the text. vocabulary: a path that every executor can open."""

    def start():
        packed = codec(vocabulary).packed

        def work(values: list) -> dict[str, pa.Array]:
            found = [packed(t or "") for t in values]
            ends = np.cumsum([0, *map(len, found)]) // 4
            return {ids: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))}

        return work

    return map_column(docs.withColumn(text, docs[text].cast("string")), text, start, f"`{ids}` array<int>", keeps=__name__)


def decode_documents(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """encoded with a text column in place of the ids; null ids give a null text."""

    def start():
        decode = codec(vocabulary).decode
        return lambda values: {"text": pa.array([None if x is None else decode(x) for x in values], pa.string())}

    return map_column(encoded, ids, start, "text string", keeps=__name__)


def digest_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: texts are encoded and decoded, and only digests leave the task."""

    def start():
        digest = codec(vocabulary).digest

        def work(values: list) -> dict[str, pa.Array]:
            found = [digest(t or "") for t in values]
            return {"n_tokens": pa.array([x[0] for x in found], pa.int64()), "ids_sha256": pa.array([x[1] for x in found], pa.string()), "decoded_sha256": pa.array([x[2] for x in found], pa.string())}

        return work

    return map_column(text_rows(docs, doc_id, text), "text", start, "n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=__name__)
