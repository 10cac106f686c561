"""Tables of terms in texts: terms are rows, however many there are; the plan doesn't grow with them.

A text is cut within its row into runs of word characters and what stands between them. Only runs that a bitmap of the terms' own runs
(bounded, whatever the number of terms) lets through are looked at further: stretches of such runs, as many as some term has, leave
the row if a bitmap of whole terms lets them through, so that what is shuffled are all but only (document, term) pairs, and they meet
the terms by an equi join on the whole stretch: no pattern is run and no text is copied or shuffled. Keys of frequent terms are dealt
to `SALTS` rows by the document.

Terms that have no run of their own between borders (other scripts, or an end with a dash) are found among stretches of
characters of the terms' lengths in the same way.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import FORMS
from .tables import SIEVE_BITS, SIEVE_BITS_EACH, cut, sifted

SALTS = 8
KNOWN = 200_000  # runs of texts that a task knows to be in a bitmap or not
PART = 1_000_000  # characters of text, or found stretches, that a task takes up at once
WORD, RUN = "a-z0-9_", "a-z0-9_-"


def flex_forms(term: Column) -> Column:
    """The term and its English plural or singular forms (see patterns.FORMS), as an array."""
    forms = [F.when((F.length(term) >= least) & F.lower(term).rlike(rf"(?:{ending})\z"), F.concat(term.substr(F.lit(1), F.length(term) - cut), F.lit(instead))) for ending, cut, instead, least in FORMS]
    return F.array_distinct(F.array_compact(F.array(term, *forms)))


def _stretches(rows: DataFrame, first: Column, step: int, sizes: Sequence[int], glue: str, around: int) -> DataFrame:
    """(doc, key, before, after) of rows (doc, tokens): for each size n, n tokens from each place first, first + step, ... on, joined; before
    and after are up to `around` characters of what stands beside them (0: none, and each key once a row)."""
    tokens, n = F.col("tokens"), F.size("tokens")

    def of_size(size: int) -> Column:
        span = size * step - (step - 1)
        last = n - span + 1
        starts = F.when(first <= last, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))
        beside = lambda i: F.coalesce(F.get(tokens, i - 1), F.lit(""))

        def key(i: Column) -> Column:
            return F.get(tokens, i - 1) if span == 1 else F.concat_ws(glue, *(F.get(tokens, i - 1 + k) for k in range(span)))

        if not around:  # strings are told apart by hashing, unlike structs
            return F.transform(starts, key)
        return F.transform(starts, lambda i: F.struct(key(i).alias("key"), F.right(beside(i - 1), F.lit(around)).alias("before"), F.left(beside(i + span), F.lit(around)).alias("after")))

    made = F.flatten(F.array(*map(of_size, sizes)))
    if around:
        return rows.select("doc", F.explode(made).alias("s")).select("doc", "s.*")
    return rows.select("doc", F.explode(F.array_distinct(made)).alias("key"))


def _met(rows: DataFrame, forms: DataFrame, holds: Column | None = None) -> DataFrame:
    """(doc, term) of rows whose key is a form's, where holds is true."""
    return _joined(sifted(rows, forms.select("key").distinct(), "key"), forms, holds)


def _found(forms: DataFrame, size: str, stretches: Callable[[list[int]], DataFrame], holds: Column | None = None) -> DataFrame | None:
    sizes = sorted(r[0] for r in forms.select(size).distinct().collect())  # as many as the longest term has runs or characters
    return _met(stretches(sizes), forms, holds) if sizes else None


class _Bitmap(dict):
    """Hashes of keys as a bitmap of SIEVE_BITS at most: `in` is false only for what isn't a key. As a dict it remembers answers."""

    def __init__(self, keys: DataFrame):
        n = keys.count()
        self.bits = min(SIEVE_BITS, 1 << max(12, (SIEVE_BITS_EACH * n).bit_length()))
        places = keys.select(F.pmod(F.crc32("key"), F.lit(self.bits)).alias("p"))
        words = places.groupBy(F.expr("p div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("b")).toArrow()
        table = np.zeros(self.bits // 64, dtype="<i8")
        table[words["w"].to_numpy()] = words["b"].to_numpy()
        self.table = table.tobytes()

    def __reduce__(self):
        return _bitmap, (self.bits, self.table)

    def has(self, key: str) -> int:
        p = zlib.crc32(key.encode()) % self.bits
        return self.table[p >> 3] >> (p & 7) & 1

    def __missing__(self, key: str) -> int:
        if len(self) > KNOWN:
            self.clear()
        found = self[key] = self.has(key)
        return found


def _bitmap(bits: int, table: bytes) -> _Bitmap:
    out = _Bitmap.__new__(_Bitmap)
    out.bits, out.table = bits, table
    return out


def _likely(texts: DataFrame, runs: _Bitmap, keys: _Bitmap, sizes: Sequence[int], between: str | None, around: int) -> DataFrame:
    """(doc, key, before, after) of texts (doc, low): stretches of so many runs that are likely keys, with up to `around` characters of
    what stands beside them (0: none, and each key once a text). Runs are split at spaces, or at what fits `between`, which
    belongs to a stretch."""
    split = re.compile(f"({between})").split if between else None

    def found_in(low: str) -> Iterator[tuple[str, str, str]]:
        parts = split(low) if split else low.split(" ")
        words, glue, step = (parts[::2], "", 2) if split else (parts, " ", 1)
        seen, last = set(), {}  # last: how many likely runs there are from one on
        at = [i for i, w in enumerate(words) if w and runs[w]]
        for i in reversed(at):
            last[i] = last.get(i + 1, 0) + 1
        for i in at:
            for size in sizes:
                if size > last[i]:
                    break
                k = i * step
                end = k + size * step - (step - 1)
                key = parts[k] if size == 1 else glue.join(parts[k:end])
                if not keys.has(key):
                    continue
                found = key, (parts[k - 1] if k else "")[-around:] if around else "", parts[end][:around] if around and end < len(parts) else ""
                if around or found not in seen:
                    seen.add(found)
                    yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            doc = of.take(pa.array([r[0] for r in out], pa.int64()))
            return pa.RecordBatch.from_arrays([doc, *(pa.array([r[c] for r in out], pa.string()) for c in (1, 2, 3))], names=["doc", "key", "before", "after"])

        for whole in batches:
            of, low, out, size = whole.column("doc"), whole.column("low"), [], 0
            for i in range(len(low)):
                for found in found_in(low[i].as_py()):
                    out.append((i, *found))
                    size += sum(map(len, found)) + 64
                    if size > PART:
                        yield batch()
                        out, size = [], 0
            if out:
                yield batch()

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.withColumn("low", F.make_valid_utf8("low")).mapInArrow(run, f"doc {kind}, key string, before string, after string")


def _joined(near: DataFrame, forms: DataFrame, holds: Column | None = None) -> DataFrame:
    """(doc, term) of rows near whose key is a form's, where holds is true."""
    near = near.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    dealt = forms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = near.join(dealt, ["key", "_salt"])
    return (met if holds is None else met.filter(holds)).select("doc", "term")


def _likely_of(texts: DataFrame, forms: DataFrame, size: str, between: str | None, around: int) -> DataFrame | None:
    """_likely with the bitmaps of forms (key, size)."""
    sizes = sorted(r[0] for r in forms.select(size).distinct().collect())  # as many as the longest term has runs
    if not sizes:
        return None
    runs = F.split("key", between or " ")
    return _likely(texts, _Bitmap(forms.select(F.explode(runs).alias("key")).distinct()), _Bitmap(forms.select("key").distinct()), sizes, between, around)


def match_term_table(docs: DataFrame, terms: DataFrame, doc_id: str, text: str, term: str = "term", flex: bool = True) -> DataFrame:
    """(doc, term), once each, where a text holds a term of the table between word borders, with its inflected forms if flex is set.

    An end of a term that is a letter, digit or underscore has a border there: an end of the text or a character that is neither
    these nor a dash. Cases are those of joins.match_terms, with which the results agree: case is folded, null
    texts and empty or null terms match nothing, repeated terms count once.
    """
    ends = lambda c: F.lower(c).rlike(f"^[{WORD}]")
    named = terms.select(F.col(term).cast("string").alias("term")).filter("term <> ''").distinct()
    named = named.select("term", ends("term").alias("left"), ends(F.right("term", F.lit(1))).alias("right"), F.explode(flex_forms(F.col("term")) if flex else F.array("term")).alias("form"))
    forms = cut(named.withColumn("form", F.lower("form")).select(
        "term", "left", "right", "form", F.regexp_extract("form", f"^([^{RUN}]*)", 1).alias("lead"), F.regexp_extract("form", rf"([^{RUN}]*)\z", 1).alias("tail"), F.size(F.regexp_extract_all("form", F.lit(f"([{RUN}]+)"), F.lit(1))).alias("runs")
    ).distinct())
    whole = F.col("runs") > 0
    for edge, border in (("lead", "left"), ("tail", "right")):
        whole = whole & ((F.col(edge) != "") | F.col(border))
    low = docs.select(F.col(doc_id).alias("doc"), F.lower(F.col(text)).alias("low")).filter("low <> ''")

    anchored = forms.filter(whole).withColumn("key", F.expr("substring(form, length(lead) + 1, length(form) - length(lead) - length(tail))"))
    around = anchored.agg(F.max(F.greatest(F.length("lead"), F.length("tail")))).first()[0] or 0
    edges = F.endswith("before", "lead") & F.startswith("after", "tail")
    near = _likely_of(low, anchored, "runs", f"[^{RUN}]+", around)
    found = None if near is None else _joined(near, anchored, edges if around else None)

    loose = forms.filter(~whole).select("term", "left", "right", F.col("form").alias("key"), F.length("form").alias("size"))
    free = lambda side, border: ~F.col(border) | ~F.col(side).rlike(f"^[{RUN}]")
    letters = low.select("doc", F.split("low", "").alias("tokens"))
    others = _found(loose, "size", lambda sizes: _stretches(letters, F.lit(1), 1, sizes, "", 1), free("before", "left") & free("after", "right"))
    both = [x for x in (found, others) if x is not None]
    if not both:
        return low.select("doc").join(named.select("term"), F.lit(False))
    return (both[0] if len(both) == 1 else both[0].unionByName(both[1])).distinct()


def phrase_hits(docs: DataFrame, forms: DataFrame, text: str, form: str = "form", words: str = r"\p{L}\p{N}") -> DataFrame:
    """(form), once each, of the lower-cased forms that some text has as a run of words."""
    bare = lambda c: F.trim(F.regexp_replace(F.lower(c), f"[^{words}]+", " "))
    keyed = cut(forms.select(F.col(form).alias("term"), bare(F.col(form)).alias("key")).filter("key <> ''").distinct().withColumn("words", F.size(F.split("key", " "))))
    low = docs.filter(F.col(text).isNotNull()).select(F.lit(0).alias("doc"), bare(F.col(text)).alias("low"))
    near = _likely_of(low, keyed, "words", None, 0)
    hits = keyed.limit(0) if near is None else keyed.join(near.select("key").distinct(), "key", "left_semi")
    return hits.select(F.col("term").alias(form)).distinct()
