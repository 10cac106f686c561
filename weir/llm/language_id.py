"""Operator 3, language ID: word-first backoff.

Training counts words by language in Spark, from a bounded sample of the labelled rows, and takes the log frequency
of every word of the sample in each language; character n-grams of all lengths up to `longest` are counted from the
same words. A text's words are looked up first; a word that isn't known is scored by its n-grams of the greatest
length of which any is known, going down to single letters. A language's score is the sum over the text's distinct
words, a word that stands n times weighing 1 + log n, and the result is the softmax over languages.

The sample is the one bound (parameters: rows and bytes): languages share it out evenly, one that has fewer rows than its
share has them all, and each has one row at least, so that none is left out. The model has a number for each word or n-gram and each language that it was met in, as sorted
arrays of hashed keys; it grows with the sample, not with the data, and is the one thing that is broadcast. Scoring
has no shuffle.

Cases: null text, or one without a letter, is `und` with score 0; a text of which no word and no n-gram is
known gets the most frequent language of training; ties go to the language first in string order; no labelled
row at all gives `und` everywhere; repeated rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_column, map_parts, materialize, text_rows, tidied

WORD = re.compile(r"[^\W\d_]+")
CACHE = 40_000_000  # bytes of word scores that a worker keeps
HELD = 100_000  # counts that a task holds before it hands them on
SEED = 42  # of Spark's xxhash64
MOST_SENT = 100_000  # rows of a table of shares that is broadcast


@dataclass(frozen=True)
class LanguageSetup:
    """The bound and the constants of training."""

    max_rows: int = 10_000  # labelled rows that training reads, drawn by a hash of their id, evenly over the languages
    max_bytes: int = 128_000_000  # of these rows' texts, shared out likewise
    longest: int = 5
    unknown_weight: float = 0.5  # an unknown word against a known one
    smoothing: float = 0.1  # added to each count


def _keys(words: Iterable[str], count: int) -> np.ndarray:
    """Spark's xxhash64 of strings, as uint64."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w.encode(), SEED) for w in words), dtype=np.uint64, count=count)


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word with marks for its ends."""
    padded = f"\x02{word}\x03"
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


class Frequencies:
    """Log frequencies by language of hashed keys: an absent key has `base`, and each (key, language) that was met adds to it."""

    def __init__(self, keys: np.ndarray, languages: np.ndarray, counts: np.ndarray, n_languages: int, smoothing: float):
        """Equal-length arrays of the counts, in any order; keys are uint64."""
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.starts = np.r_[first, len(keys)]
        self.languages = languages[order].astype(np.int32)
        self.gains = np.log((counts[order] + smoothing) / smoothing).astype(np.float32)
        totals = np.bincount(languages, weights=counts, minlength=n_languages)
        self.base = np.log(smoothing / (totals + smoothing * max(1, len(self.keys)))).astype(np.float32)

    def sums(self, keys: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """((n, languages) sums of the log frequencies of each owner's known keys, the number of these)."""
        width = len(self.base)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        at, owners = at[known], owners[known]
        found = np.bincount(owners, minlength=n)
        many = self.starts[at + 1] - self.starts[at]
        entries = np.repeat(self.starts[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        gains = np.bincount(np.repeat(owners, many) * width + self.languages[entries], weights=self.gains[entries], minlength=n * width)
        return gains.reshape(n, width) + found[:, None] * self.base[None, :], found


class LanguageModel:
    """What is broadcast: the languages, their shares of the labelled rows, and the frequencies of words and n-grams."""

    def __init__(self, languages: list[str], prior: list[float], words: Frequencies, grams: Frequencies, setup: LanguageSetup):
        self.languages, self.prior, self.words, self.grams, self.setup = languages, prior, words, grams, setup

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "table", "used")}

    def rows(self, words: list[str]) -> np.ndarray:
        """(words, languages): each word's score in each language; zeros where nothing is known of it."""
        n = len(words)
        out, found = self.words.sums(_keys(words, n), np.arange(n), n)
        known = found > 0
        todo = np.flatnonzero(~known)
        for size in range(self.setup.longest, 0, -1):
            if not len(todo):
                break
            grams = [grams_of(words[i], size) for i in todo]
            owners = np.repeat(np.arange(len(todo)), [len(g) for g in grams])
            sums, some = self.grams.sums(_keys((g for of in grams for g in of), len(owners)), owners, len(todo))
            hit = some > 0
            out[todo[hit]] = sums[hit] / some[hit][:, None] * self.setup.unknown_weight
            known[todo[hit]] = True
            todo = todo[~hit]
        out -= out.mean(axis=1, keepdims=True)
        out[~known] = 0
        return out.astype(np.float32)

    def predict_many(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text. Words that weren't met before are looked up together."""
        width = len(self.languages)
        if not width:
            return [("und", 0.0)] * len(texts)
        if not hasattr(self, "known") or self.used * width * 4 > CACHE:
            self.known, self.table, self.used = {}, np.zeros((1024, width), dtype=np.float32), 0
        known = self.known
        counted = [Counter(WORD.findall(t.lower())) if t else Counter() for t in texts]
        new = list(dict.fromkeys(w for counts in counted for w in counts if w not in known))
        if new:
            if self.used + len(new) > len(self.table):
                self.table = np.vstack([self.table, np.zeros((len(self.table) + len(new), width), dtype=np.float32)])
            self.table[self.used : self.used + len(new)] = self.rows(new)
            known.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
        out = []
        for counts in counted:
            if not any(c.isalpha() for w in counts for c in w):
                out.append(("und", 0.0))
                continue
            times = 1 + np.log(np.fromiter(counts.values(), dtype=np.float32, count=len(counts)))
            total = times @ self.table[[known[w] for w in counts]]
            if not np.any(total):
                total = np.asarray(self.prior, dtype=np.float32)
            best = int(np.argmax(total))
            out.append((self.languages[best], float(1 / np.exp(np.clip(total - total[best], -60, 0)).sum())))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_many([text])[0]


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About `bound` rows at most (within a few per cent), drawn by a hash of the key; all rows where there are fewer."""
    n = rows.count()
    return rows if n <= bound else rows.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def _quota(counts: list[int], bound: int) -> float:
    """The rows that each class may have so that all together have `bound`, those with fewer having all of theirs."""
    left, todo = bound, sorted(counts)
    for k, n in enumerate(todo):
        if n * (len(todo) - k) > left:
            return max(1.0, left / (len(todo) - k))
        left -= n
    return float(max(todo, default=0))


def even_sample(rows: DataFrame, key: str, by: str, bound: int, text: str | None = None, most_bytes: int = 0) -> tuple[DataFrame, dict]:
    """Rows drawn evenly over the values of `by`, `bound` in all (and one of each value, if there are more values than that), and
    the rows of each value in all. Of a value with more rows than its share, those with the least hash of the key are drawn; with
    `text`, no more of them than have `most_bytes` of text over all values together (and one of each).

    Ranks are taken among few rows more than are drawn: a first sieve by the hash lets some more than a share through.
    """
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}
    quota = ceil(_quota(list(counts.values()), bound))
    # of 50 rows more than a share and ten standard deviations, a share is left but for a chance of about e^-50
    cut = [(v, min(1.0, (quota + 10 * sqrt(quota) + 50) / n)) for v, n in counts.items()]
    shares = rows.sparkSession.createDataFrame(cut, T.StructType([T.StructField(by, rows.schema[by].dataType), T.StructField("_share", T.DoubleType())]))
    # a row for each value: sent to all tasks, unless there are very many, so that no text is shuffled before it is drawn
    shares = F.broadcast(shares) if len(cut) <= MOST_SENT else shares
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 40))
    near = rows.withColumn("_place", place).join(shares, by).filter(F.col("_place") < F.col("_share") * (1 << 40)).drop("_share")
    w = Window.partitionBy(by).orderBy("_place")
    ranked = near.withColumn("_rank", F.row_number().over(w))
    fits = F.col("_rank") <= quota
    if text is not None:
        ranked = ranked.withColumn("_bytes", F.sum(F.octet_length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        fits = fits & ((F.col("_rank") == 1) | (F.col("_bytes") <= most_bytes / max(1, len(counts))))
    return ranked.filter(fits).select(rows.columns), counts


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of all words of (lang, text)."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for language, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(language, Counter()).update(WORD.findall(t.lower()))
            if sum(map(len, held.values())) > HELD:
                yield from _handed_on(held, "word", lambda words: pa.array(words, pa.string()), pa.int64())
        yield from _handed_on(held, "word", lambda words: pa.array(words, pa.string()), pa.int64())

    return map_parts(rows.select("lang", "text"), "text", words_of, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _handed_on(held: dict[str, Counter], name: str, keys: Callable[[list[str]], pa.Array], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The counts by language, which are no longer held then; Spark sums them up."""
    for language, counts in held.items():
        n = pa.array(list(counts.values()), kind)
        yield pa.RecordBatch.from_arrays([pa.array([language] * len(counts), pa.string()), keys(list(counts)), n], names=["lang", name, "n"])
    held.clear()


def _gram_counts(words: DataFrame, longest: int) -> DataFrame:
    """(lang, key, n) of all n-grams of (lang, word, n). A word's n-grams count by the root of its number: frequent words don't drown the rest."""

    hashed = lambda grams: pa.array(_keys(grams, len(grams)).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for k, (language, word, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True)):
                counts, root = held.setdefault(language, Counter()), sqrt(n)
                for size in range(1, min(longest, len(word) + 2) + 1):
                    for g in grams_of(word, size):
                        counts[g] += root
                if k % 1000 == 0 and sum(map(len, held.values())) > HELD:
                    yield from _handed_on(held, "key", hashed, pa.float64())
        yield from _handed_on(held, "key", hashed, pa.float64())

    return words.mapInArrow(tidied(run), "lang string, key long, n double").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, setup: LanguageSetup = LanguageSetup(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Model from rows with text and language; rows without either are left out."""
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    drawn, by_language = even_sample(rows, "id", "lang", setup.max_rows, "text", setup.max_bytes)
    words = materialize(_counted(drawn), "language-words")
    names = sorted(by_language)
    place = {x: k for k, x in enumerate(names)}

    def frequencies(counts: DataFrame) -> Frequencies:
        found = counts.toPandas()  # of the bounded sample
        return Frequencies(found["key"].to_numpy(dtype=np.int64).view(np.uint64), found["lang"].map(place).to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.float64), len(names), setup.smoothing)

    total = max(1, sum(by_language.values()))
    return LanguageModel(names, [float(np.log(by_language[x] / total)) for x in names], frequencies(words.select("lang", F.xxhash64("word").alias("key"), "n")), frequencies(_gram_counts(words, setup.longest)), setup)


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, lang_pred, score and the carried columns for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        predict_many = shared.value.predict_many

        def work(values: list) -> dict[str, pa.Array]:
            found = predict_many(values)
            return {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([y for _, y in found], pa.float64())}

        return work

    return map_column(text_rows(docs, doc_id, text, carry), "text", start, "lang_pred string, score double")
