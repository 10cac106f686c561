"""Patterns built once on the driver: globs, ordered classes, terms with their inflected forms."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """`**/` none or more folders, `**` anything, `*` within a segment, `?` one character of a segment; anchored."""
    out, k = [], 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out.append("(?:[^/]+/)*")
            k += 3
        elif pattern.startswith("**", k):
            out.append(".*")
            k += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(pattern[k], re.escape(pattern[k])))
            k += 1
    return "^" + "".join(out) + "$"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def match_any(path: Column, globs: Sequence[str]) -> Column:
    """Any of the globs; one without a slash is held against the last segment."""
    return reduce(lambda a, b: a | b, (glob_match(path if "/" in g else basename(path), g) for g in globs), F.lit(False))


def _head_match(path: Column, pattern: str) -> Column:
    if pattern.endswith("/**"):
        head = pattern[:-3]
        return (path == head) | path.startswith(head + "/")
    segments = F.split(path, "/")
    parts = pattern.split("/")
    whole = reduce(lambda a, b: a & b, (segments[i].rlike(glob_regex(p)) for i, p in enumerate(parts)))
    return (F.size(segments) >= len(parts)) & whole


def domain_of(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Name of the first rule (name, patterns split by '|') whose pattern fits the head of the path; else null."""
    path = F.translate(path, "\\", "/")
    out = F.lit(None).cast("string")
    for name, patterns in reversed(rules):
        fits = reduce(lambda a, b: a | b, (_head_match(path, p.strip()) for p in patterns.split("|")))
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


# Endings of English words, how many letters of them go, what comes instead, and the least length of a term.
FORMS = [("[a-z]", 0, "s", 1), ("s|x|z|ch|sh|[^aeiou]o", 0, "es", 1), ("[^aeiou]y", 1, "ies", 1), ("ies", 3, "y", 5), ("(?:s|x|z|ch|sh|o)es", 2, "", 5), ("[^sui]s", 1, "", 4)]


def flex_variants(term: str) -> list[str]:
    """The term and its English plural or singular forms; only the end of a phrase changes."""
    fitting = (row for row in FORMS if len(term) >= row[3] and re.search(f"(?:{row[0]})$", term.lower()))
    return list(dict.fromkeys([term, *(term[: len(term) - cut] + instead for _, cut, instead, _ in fitting)]))


def flex_pattern(term: str) -> str:
    """Regular expression of a term with its forms; a side that is a word character needs a border there."""
    word, border = re.compile("[a-z0-9_]", re.I), "[^a-z0-9_-]"
    left, right = (f"({edge}|{border})" if end and word.match(end) else "" for edge, end in (("^", term[:1]), ("$", term[-1:])))
    return left + "(?:" + "|".join(re.escape(v.lower()) for v in flex_variants(term)) + ")" + right


#: Runs of the characters that borders of terms keep apart.
RUN = "[a-z0-9_-]+"


def _single(term: str) -> list[str] | None:
    """The forms of a term that is one run between borders; None for phrases and other scripts."""
    forms = [v.lower() for v in flex_variants(term)]
    return forms if all(re.fullmatch("[a-z0-9_](?:[a-z0-9_-]*[a-z0-9_])?", v) for v in forms) else None


def runs_of(text: Column, terms: Sequence[str]) -> Column:
    """The runs of a lower-cased text that are forms of one-run terms: one look at the text for all terms."""
    forms = sorted({v for t in terms for v in _single(t) or []})
    return F.array_intersect(F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(1)), F.array(*map(F.lit, forms))) if forms else F.array().cast("array<string>")


def holds(text: Column, runs: Column, term: str) -> Column:
    """matches(text, term), where runs are the text's runs_of terms with this one."""
    if not term:
        return F.lit(False)
    if forms := _single(term):
        return F.arrays_overlap(runs, F.array(*map(F.lit, forms)))
    if len(variants := flex_variants(term)) == 1 and not re.match("[a-z0-9_]", term[:1] + term[-1:], re.I) and not re.search("[a-z0-9_]", term[-1:], re.I):
        return F.contains(text, F.lit(variants[0].lower()))
    return matches(text, term)


def held(text: Column, runs: Column, terms: Sequence[str]) -> Column:
    """The terms that a text holds, in their order."""
    return F.array_compact(F.array(*(F.when(holds(text, runs, t), F.lit(t)) for t in terms))) if terms else F.array().cast("array<string>")


def holds_any(text: Column, runs: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (holds(text, runs, t) for t in terms), F.lit(False))


def matches(text: Column, term: str) -> Column:
    """Whether a lower-cased text holds the term. An empty term is held by none."""
    return text.rlike(flex_pattern(term)) if term else F.lit(False)


def matches_any(text: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (matches(text, t) for t in terms), F.lit(False))
