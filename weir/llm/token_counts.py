"""Operator 5, token counts: rank-synchronous array merging of byte-level BPE.

Texts are split into pre-tokens; the pre-tokens of a batch that the worker hasn't counted yet are held as one
ragged pair of numpy arrays (symbols, sequence starts). A round looks up the merge rank of every adjacent
pair, takes each sequence's lowest rank and applies that pair at all its places in that sequence at once, left to
right where places overlap; when no sequence has a mergeable pair, the surviving symbols are counted.

There is no shuffle: each task counts its own texts, in slices of bounded size. The only state is a bounded
cache of counts by pre-token.

Cases: null text counts as empty (0 bytes, 0 tokens); special strings inside a text count as the library's
default has them (one token each, and text on both sides is tokenised apart); repeated rows give equal rows;
other columns are not read; an empty table gives an empty table; a lone surrogate can't occur in Spark text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_column, text_rows

CACHE = 150_000  # pre-tokens whose counts a worker keeps
SLICE_CHARS = 400_000  # text handled at once
NONE = np.int64(1 << 40)


# Letters and numbers of Unicode versions after 16.0, which the vocabularies' library takes for other marks.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB "
    "11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 "
    "191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)


class Splitter:
    """findall of a split pattern with the library's idea of letters and numbers."""

    def __init__(self, pattern: str):
        import regex

        newer = "[" + "".join("-".join(rf"\U{int(x, 16):08X}" for x in r.split("-")) for r in NEWER.split()) + "]"
        self.has_newer = re.compile(newer).search
        self.usual = regex.compile(pattern).findall
        self.exact = regex.compile(pattern.replace(r"\p{L}", rf"[\p{{L}}--{newer}]").replace(r"\p{N}", rf"[\p{{N}}--{newer}]"), regex.V1).findall

    def __call__(self, text: str) -> list[str]:
        return self.usual(text) if text.isascii() or not self.has_newer(text) else self.exact(text)


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: printable Latin-1 stands for
    itself, the other bytes are numbered on from U+0100 in order."""
    out, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class PairRanks:
    """Merge ranks of symbol pairs, looked up by binary search in one sorted array of pair keys."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        self.size = len(vocab)
        left, right, made = [], [], []
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(vocab[a]), right.append(vocab[b]), made.append(vocab[a + b])
        keys = np.array(left, dtype=np.int64) * self.size + np.array(right, dtype=np.int64)
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.ranks = keys, first.astype(np.int64)
        self.made = np.array(made, dtype=np.int64)
        self.of_byte = np.zeros(256, dtype=np.int64)
        for c, b in byte_symbols().items():
            self.of_byte[b] = vocab[c]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_ragged(symbols: np.ndarray, lengths: np.ndarray, pairs: PairRanks) -> np.ndarray:
    """Surviving symbols of each sequence. symbols: all sequences, end to end; every length is 1 or more."""
    survivors = lengths.astype(np.int64).copy()
    live = np.arange(len(lengths))
    seq = np.repeat(live, lengths)
    while len(symbols) > 1:
        inside = seq[1:] == seq[:-1]
        rank = np.full(len(symbols), NONE)
        where = np.flatnonzero(inside)
        rank[where] = pairs.ranks_of(symbols[where], symbols[where + 1])
        starts = np.flatnonzero(np.r_[True, ~inside])
        lowest = np.minimum.reduceat(rank, starts)
        going = lowest < NONE
        counts = np.diff(np.r_[starts, len(symbols)])
        if not going.all():
            keep = np.repeat(going, counts)
            symbols, seq, rank = symbols[keep], seq[keep], rank[keep]
            lowest, counts = lowest[going], counts[going]
            if not len(symbols):
                break
        hit = rank == np.repeat(lowest, counts)
        # in a run of neighbouring places (as in "aaa") every second one merges, counted from the run's start
        places = np.flatnonzero(hit)
        run_start = np.r_[True, (np.diff(places) > 1)]
        nth = np.arange(len(places)) - np.maximum.accumulate(np.where(run_start, np.arange(len(places)), 0))
        places = places[nth % 2 == 0]
        symbols = symbols.copy()
        symbols[places] = pairs.made[rank[places]]
        np.subtract.at(survivors, seq[places], 1)
        left = np.ones(len(symbols), dtype=bool)
        left[places + 1] = False
        symbols, seq = symbols[left], seq[left]
    return survivors


class Counter:
    """Counts tokens of texts with one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError("byte-level BPE vocabularies without a normalizer are supported")
        self.pairs = PairRanks(spec)
        #: The split of byte-level pre-tokenisers, a fixed value of the format.
        self.split = Splitter(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def _pieces(self, text: str) -> tuple[list[str], int]:
        if self.special is None or not self.special.search(text):
            return self.split(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.split(part)], len(parts) - 1

    def _learn(self, new: list[str]) -> None:
        raw = [p.encode() for p in new]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbols = self.pairs.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        self.known.update(zip(new, merge_ragged(symbols, lengths, self.pairs).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        cut = [self._pieces(t) for t in texts]
        new = list({p for pieces, _ in cut for p in pieces}.difference(self.known))
        for i in range(0, len(new), 50_000):
            self._learn(new[i : i + 50_000])
        known = self.known.__getitem__
        out = [sum(map(known, pieces)) + n for pieces, n in cut]
        if len(self.known) > CACHE:
            self.known.clear()
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `chars` characters together (one text at least)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. vocabulary: a path that every executor can open."""

    def start():
        count = counter(vocabulary).count

        def work(values: list) -> dict[str, pa.Array]:
            texts = [t or "" for t in values]
            tokens: list[int] = []
            for a, b in slices(texts):
                tokens += count(texts[a:b])
            return {"n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array([n > limit for n in tokens], pa.bool_())}

        return work

    return map_column(text_rows(docs, doc_id, text), "text", start, "n_bytes long, n_tokens long, over_limit boolean")
