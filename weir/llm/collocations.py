"""Operator 12, phrase collocation mining: SON partitioning.

The input's partitions are dealt to `shards` shards of about equal share. A phrase that occurs `support` times in all occurs
support / shards times, rounded up, in one shard at least: each shard is mined completely at that local support, and all that is
frequent in some shard is counted again, exactly, over all texts.

1. Words and pairs of every shard, then phrases of three words and more whose pairs are all frequent in some shard, are
   counted by 64-bit hashes: a shard is spread over many tasks, and what is shuffled is (shard, hash, count), counted within
   each task first. Two phrases of one hash make a candidate too many, never one too few.
2. The union of what is locally frequent is a bitmap of hashes, with 16 bits for each candidate and 2^27 bits (16 MB) at most;
   where it is fuller, more phrases are counted in step 3, with equal results.
3. Every phrase whose words and parts all pass is counted by its words (not by a hash), within each task first, then by
   language and phrase. All parts of a phrase that is frequent are frequent, so that their counts are there too.
4. Scores, the longer phrases and the best of each language are joins and groupings of the counted phrases. The best are
   taken in stretches of a language's phrases first, so that no task sorts a whole language.

Texts are read in parts of 2 MB as arrays of bytes; words of a part are hashed all at once.

Cases: null texts count as empty; a null language is `und`, together with rows that are marked so; repeated rows count as often
as they occur; ties go by the count, then the phrase; doc_id may be null and isn't read, nor are other columns; texts are read
whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_parts, materialize

BREAK = 255  # never a byte of UTF-8
FOLD = bytes(BREAK if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
HELD = 2_500_000  # hashes that a task holds before it counts them
WORDS = 300_000  # words of texts, or distinct words, that a task holds before it counts them
MOST_BITS = 1 << 27
U = np.uint64
PRIME, MIX = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)
UNKNOWN = "und"


def _stir(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * MIX
    return h ^ (h >> U(29))


VALUE = _stir(np.arange(1, 257, dtype=U) * PRIME) | U(1)  # of a byte in a word's hash


class Words:
    """The words of some texts: where they stand in `text` (folded bytes), their piece, and their hash with the language's."""

    def __init__(self, texts: Sequence[str | None], langs: Sequence[str | None]):
        raw = [(t or "").encode() for t in texts]
        self.text = bytes([BREAK]).join([*raw, b""]).translate(FOLD)
        letters = np.frombuffer(self.text, dtype=np.uint8)
        inside = (letters != 32) & (letters != BREAK)
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(letters == BREAK)[self.start]
        ends = np.cumsum([len(t) + 1 for t in raw])
        langs = [UNKNOWN if lang is None else lang for lang in langs]
        self.names = list(dict.fromkeys(langs))
        number = {name: i for i, name in enumerate(self.names)}
        of_text = np.array([number[lang] for lang in langs], dtype=np.int64)
        self.lang = of_text[np.searchsorted(ends, self.start, side="right")] if len(raw) else np.zeros(0, np.int64)
        self.hash = self._hashes(letters, inside)

    def _hashes(self, letters: np.ndarray, inside: np.ndarray) -> np.ndarray:
        length = self.end - self.start
        if not len(length):
            return np.zeros(0, U)
        first = np.cumsum(length) - length
        power = np.multiply.accumulate(np.full(int(length.max()), PRIME, dtype=U))
        place = np.arange(int(length.sum())) - np.repeat(first, length)
        h = np.add.reduceat(VALUE[letters[inside]] * power[place], first)
        seeds = np.array([np.add.reduce(VALUE[np.frombuffer(b"\x00" + name.encode(), np.uint8)] * np.multiply.accumulate(np.full(len(name.encode()) + 1, MIX))) for name in self.names], dtype=U)
        return _stir(h + seeds[self.lang] * PRIME)

    def together(self, n: int) -> np.ndarray:
        """Whether the n words from here on are of one piece."""
        return self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :] if len(self.piece) >= n else np.zeros(0, bool)

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """(n, hash of the n words from each place on) for n up to longest."""
        h = self.hash
        for n in range(1, longest + 1):
            if n > 1:
                h = _stir(h[:-1] * PRIME + self.hash[n - 1 :]) if len(self.hash) >= n else h[:0]
            yield n, h


class Bitmap:
    """Hashes of candidates."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, U(bits - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & self.bits
        return (self.words[at >> U(6)] >> (at & U(63))) & U(1) == 1


def _runs(ok: np.ndarray, n: int) -> np.ndarray:
    """Whether ok holds at the n places from here on."""
    out = ok[: len(ok) - n + 1] if len(ok) >= n else ok[:0]
    for k in range(1, n):
        out = out & ok[k : len(ok) - n + 1 + k]
    return out


def _locally(rows: DataFrame, shards: int, least: int, pick: Callable[[Words], list[np.ndarray]]) -> DataFrame:
    """(h): hashes of phrases that pick gives and that some shard has `least` times."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            found = pick(Words(batch.column("text").to_pylist(), batch.column("lang").to_pylist()))
            held += found
            size += sum(map(len, found))
            if size >= HELD:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    found = map_parts(rows, "text", run, "h long, n long").withColumn("shard", F.spark_partition_id() % shards)
    return found.groupBy("shard", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h")


def _bitmap(hashes: DataFrame, most_bits: int) -> Bitmap:
    """hashes (repeats do no harm) as a bitmap: at most most_bits / 64 rows come to the driver."""
    held = materialize(hashes, "phrases")
    bits = min(most_bits, 1 << max(12, (16 * held.count()).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = held.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("bits")).toArrow()
    words = np.zeros(bits // 64, dtype=U)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(U)
    return Bitmap(words, bits)


class _Ids(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class Exact:
    """Counts phrases by their words, in stretches of texts."""

    def __init__(self, longest: int):
        self.longest, self.parts, self.size = longest, [], 0
        self.word, self.name = _Ids(), _Ids()

    def add(self, words: Words, fits: list[np.ndarray]) -> None:
        """fits: for n = 1, 2, ..., whether the phrase of n words from each place on is to be counted."""
        at = np.flatnonzero(fits[0])
        ids = np.zeros(len(words.hash), dtype=np.int64)
        text = words.text
        ids[at] = np.fromiter((self.word[text[a:b]] for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)), dtype=np.int64, count=len(at))
        lang = np.array([self.name[name] for name in words.names], dtype=np.int64)[words.lang] if len(words.lang) else words.lang
        self.parts.append((lang, ids, [np.pad(f, (0, len(ids) - len(f))) for f in fits]))
        self.size += len(ids)

    def full(self) -> bool:
        return self.size >= WORDS or len(self.word) >= WORDS

    def take(self) -> pa.RecordBatch:
        """lang, phrase, n; an empty phrase has the number of all words."""
        names, words = list(self.name), list(self.word)
        lang, ids = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        out_lang, out_phrase, out_n = [], [], []
        total = np.bincount(lang, minlength=len(names))
        out_lang += [n for n, k in zip(names, total, strict=True) if k]
        out_phrase += [b""] * len(out_lang)
        out_n += total[total > 0].tolist()
        code, base = lang, np.int64(max(1, len(words)))
        phrases, langs = [b""] * len(names), names
        for n in range(1, self.longest + 1):
            at = np.flatnonzero(np.concatenate([p[2][n - 1] for p in self.parts]))
            keys, places, counts = np.unique(code[at] * base + ids[at + n - 1], return_inverse=True, return_counts=True)
            code = np.zeros(len(ids), dtype=np.int64)
            code[at] = places
            before, last = (keys // base).tolist(), (keys % base).tolist()
            phrases, langs = [phrases[p] + b" " + words[w] if n > 1 else words[w] for p, w in zip(before, last, strict=True)], [langs[p] for p in before]
            out_lang += langs
            out_phrase += phrases
            out_n += counts.tolist()
        self.__init__(self.longest)
        return pa.RecordBatch.from_arrays([pa.array(out_lang, pa.string()), pa.array(out_phrase, pa.binary()).cast(pa.string()), pa.array(out_n, pa.int64())], names=["lang", "phrase", "n"])


def count_phrases(docs: DataFrame, support: int = 30, longest: int = 4, shards: int = 8, text: str = "text", lang: str = "lang", most_bits: int = MOST_BITS) -> DataFrame:
    """lang, phrase, f: every phrase of 1 to `longest` words with f occurrences, `support` or more, in its language; beside
    them, with an empty phrase, the number of all words of each language."""
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    least = -(-support // shards)

    def short(words: Words) -> list[np.ndarray]:
        return [h[words.together(n)] for n, h in words.phrases(min(2, longest))]

    sieve = [rows.sparkSession.sparkContext.broadcast(_bitmap(_locally(rows, shards, least, short), most_bits))]

    def long(words: Words) -> list[np.ndarray]:
        out, pairs = [], None
        for n, h in words.phrases(longest):
            if n == 2:
                pairs = sieve[0].value.has(h) & words.together(2)
            elif n > 2:
                out.append(h[_runs(pairs, n - 1)])
        return out

    if longest > 2:
        sieve.append(rows.sparkSession.sparkContext.broadcast(_bitmap(_locally(rows, shards, least, long), most_bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Exact(longest)
        for batch in batches:
            words = Words(batch.column("text").to_pylist(), batch.column("lang").to_pylist())
            fits: list[np.ndarray] = []
            for n, h in words.phrases(longest):
                fit = sieve[n > 2].value.has(h) & words.together(n)
                fits.append(fit & _runs(fits[-1], 2) if fits else fit)
            counter.add(words, fits)
            if counter.full():
                yield counter.take()
        if counter.size:
            yield counter.take()

    counted = map_parts(rows, "text", run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    out = materialize(counted.filter((F.col("f") >= support) | (F.col("phrase") == "")), "counts")
    for s in sieve:
        s.unpersist()
    return out


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def mine(docs: DataFrame, support: int = 30, longest: int = 4, shards: int = 8, scale: int = 2_000_000, covered: int = 80, best: int = 2000, text: str = "text", lang: str = "lang", most_bits: int = MOST_BITS) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the `best` phrases of 2 to `longest` words of each language.

    a, l, r: occurrences of the phrase, of its first part and of the rest, for the cut with the least score,
    floor(scale * a / (l + r)); n: all words of the language. A phrase goes if a longer one that has it occurs `covered`
    per cent as often or more.
    """
    counts = count_phrases(docs, support, longest, shards, text, lang, most_bits)
    known = counts.filter("phrase <> ''")
    phrases = known.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words")).filter("size > 1")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(count)), ["lang", part])
    score = F.expr(f"(CAST(a AS DECIMAL(38,0)) * {scale}) div CAST(l + r AS DECIMAL(38,0))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: _part(i, n))))
    longer = phrases.filter("size > 2").select("lang", F.col("f"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * covered)).drop("longer")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = kept.withColumn("stretch", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "stretch").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    totals = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
