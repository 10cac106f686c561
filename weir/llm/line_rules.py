"""Operator 10, quality rules: line-first cleaning, in native expressions only.

Every line is judged by itself (punctuation, navigation, boilerplate); failing lines are removed;
a document that loses too much of its text is rejected. The base counts (repeated windows, repeated
lines, symbols) come from the whole text. There is no shuffle: each row is judged from its own text,
and the work for a text is O(n log n) in its words.

Cases: null text counts as no text (0 words, base_failed, not kept); an empty text likewise; repeated
rows give equal repeated rows; other columns are carried unless they clash with an output name, which
the output then replaces; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, let

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules."""

    max_symbol_share: float = 0.08  # of a line's characters
    min_pipes: int = 2  # separators that make a line navigation
    min_open_words: int = 80  # a line of so many words with no sentence punctuation fails
    max_lost_share: float = 0.5  # of the document's word characters, in failing lines
    min_words: int = 10
    max_repeat_percent: int = 20
    boilerplate: str = r"(?i)\b(licensed under|released under|all rights reserved|cookie policy|privacy policy|terms of (use|service)|subscribe to|click here|sign in|log in|enable javascript|skip to content)\b"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a window of `width` words which the list holds twice or more.

    Windows are compared by 64-bit hashes, sorted (never pairwise), and overlapping windows count a word once.
    """

    def count(hashes: Column) -> Column:
        starts = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        doubled = let(
            F.sort_array(starts),
            lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
        )
        spans = F.aggregate(
            F.sort_array(F.transform(doubled, lambda x: x["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")),
        )["n"]
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(spans)

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashed) - width + 1), lambda i: F.xxhash64(F.slice(hashed, i, width)))

    return F.when(F.size(words) >= width + 1, let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashed: let(windows(hashed), count))).otherwise(F.lit(0))


def _chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, ""))


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def line_fails(line: Column, rules: LineRules) -> Column:
    """Punctuation, navigation and boilerplate rules for one line."""
    chars = _chars(line)
    pipes = F.length(line) - F.length(F.translate(line, "|", ""))
    open_run = (chars > rules.min_open_words * 2) & ~line.rlike(r"[.!?:;,…。]") & (F.length(line) - chars >= rules.min_open_words - 1)
    return (_symbols(line) > rules.max_symbol_share * chars) | (pipes >= rules.min_pipes) | open_run | line.rlike(rules.boilerplate)


def judge(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_failed_lines, kept_share (word characters in passing lines), clean_text and kept."""
    own = ["_text", "_words", "_lines", "_failed"]
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines", "kept_share", "clean_text", "kept"]
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    df = docs.withColumn("_text", t).drop(*out)
    filled = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    df = df.withColumns({"_words": words_of(F.col("_text")), "_lines": filled})
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": _chars(F.col("_text")).cast("long"),
        "n_symbols": _symbols(F.col("_text")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "_good": F.filter("_lines", lambda x: ~line_fails(x, rules)),
    })
    good_chars = F.aggregate("_good", F.lit(0), lambda a, x: a + _chars(x))
    df = df.withColumns({
        "n_failed_lines": F.col("n_lines") - F.size("_good"),
        "kept_share": F.when(F.col("word_chars") > 0, good_chars / F.col("word_chars")).otherwise(0.0),
        "clean_text": F.array_join("_good", "\n"),
        "base_failed": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
    })
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= 1 - rules.max_lost_share))
    return df.drop(*own, "_good")
