"""Row filters and flags: captures, levels, hints, decisions, freshness, rule fan-out, severities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import latest


def filter_requests(df: DataFrame, pattern: str = "", method: str | None = None, limit: int | None = None, regex: bool = False, url: str = "url", method_col: str = "method", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Captured requests whose url holds the pattern (any case) or fits it as a regex, of one method; the last `limit`."""
    if pattern:
        df = df.filter(F.col(url).rlike(pattern) if regex else F.contains(F.lower(url), F.lit(pattern.lower())))
    if method:
        df = df.filter(F.upper(method_col) == method.upper())
    return df if limit is None else latest(df, limit, order)


def filter_levels(df: DataFrame, levels: Sequence[str] = (), text: str = "", limit: int | None = None, level_col: str = "level", text_col: str = "text", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Log rows of some levels (any case) whose text holds `text`; the last `limit`."""
    if levels:
        df = df.filter(F.lower(level_col).isin(*(x.lower() for x in levels)))
    if text:
        df = df.filter(F.contains(F.lower(text_col), F.lit(text.lower())))
    return df if limit is None else latest(df, limit, order)


def truncate_bodies(df: DataFrame, max_chars: int, body: str = "body") -> DataFrame:
    """body cut to max_chars (0: whole), with truncated and full_length."""
    n = F.length(body)
    if not max_chars:
        return df.withColumns({"truncated": F.lit(False), "full_length": n})
    return df.withColumns({"truncated": F.coalesce(n > max_chars, F.lit(False)), "full_length": n, body: F.left(body, F.lit(max_chars))})


# Prompts, prefixes and patterns of texts that aren't requests.
SKIP_EXACT = ["ok", "继续", "好", "嗯", "做", "是", "对", "行", "可以", "y", "yes", "go", "next"]
SKIP_PREFIX = ["This session is being continued", "Caveat:", "<command-", "<local-command", "<system-reminder", "SessionStart:", "Continue"]
NOISE = [
    r"^<task-notification>",
    r"Another \w+ session sent a message|<agent-message|^<\w+-mem",
    r"^Skill /\S+ is already loaded|^Base directory for this skill:",
    r"Background agent .+ was (stopped|started)|^Stop hook feedback|tool-use-id|^\[Request interrupted by user",
    r"^Exit code: \d+",
]


def clean_hints(df: DataFrame, text: str = "text", out: str = "hint", least: int = 10, most: int = 4000, prefixes: Sequence[str] = SKIP_PREFIX, noise: Sequence[str] = NOISE) -> DataFrame:
    """Rows whose trimmed text is a request: not on the skip lists, 10 to 4000 characters, no bare path or command, no noise."""
    t = F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")
    bad = t.isin(*SKIP_EXACT) | reduce(lambda a, b: a | b, (t.startswith(p) for p in prefixes), F.lit(False))
    bad = bad | ~F.length(t).between(least, most) | t.rlike(r"^[\p{L}\p{N}_\-./\\: ]+$") | reduce(lambda a, b: a | b, (F.left(t, F.lit(400)).rlike(p) for p in noise), F.lit(False))
    return df.filter(F.col(text).isNotNull()).withColumn(out, t).filter(~bad)


def suspicious(decisions: DataFrame) -> DataFrame:
    """Hand-offs without a domain, and questions that only the lexical fallback suggested."""
    return decisions.filter(((F.col("domain") == "none") & (F.col("action") == "handoff")) | ((F.col("action") == "ask") & F.exists("reasons", lambda r: r.startswith("lexical_fallback"))))


def weak_decisions(decisions: DataFrame) -> DataFrame:
    return decisions.filter((F.col("action") != "dispatch") | (F.col("confidence") != "high"))


def with_expectation(cases: DataFrame, expect: str = "expect") -> DataFrame:
    """cases with wanted (skills and anySkills together) and oos (no domain, or a hand-off, is expected)."""
    empty = F.array().cast("array<string>")
    e = F.col(expect)
    wanted = F.array_union(F.coalesce(e["skills"], empty), F.coalesce(e["anySkills"], empty))
    return cases.withColumns({"wanted": wanted, "oos": F.coalesce(e["domain"] == "none", F.lit(False)) | F.coalesce(e["action"] == "handoff", F.lit(False))})


def restrict_to_changed(edges: DataFrame, changed: DataFrame, key: str = "edge_id", src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """Edges whose source or target is in the changed set, each once. Rules over all edges aren't sound on this view."""
    ids = changed.select(F.col(node).alias("_node")).distinct()
    hit = edges.select(key, F.explode(F.array(src, dst)).alias("_node")).join(ids, "_node", "left_semi").select(key).distinct()
    return edges.join(hit, key, "left_semi")


def rule_fanout(df: DataFrame, rules: Sequence[tuple[str, str, bool]], id_col: str, path: str) -> DataFrame:
    """(id, jobs) where rules are (pattern, job, global): all jobs of the patterns that a row fits. If any row fits a
    global rule or no rule at all, every row gets the job 'all' as well."""
    hits = F.array(*(F.when(F.col(path).rlike(p), F.lit(job)) for p, job, _ in rules))
    wide = reduce(lambda a, b: a | b, (F.col(path).rlike(p) for p, _, g in rules if g), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.array_compact(hits))).alias("jobs"), wide.alias("wide"))
    upgrade = rows.agg(F.coalesce(F.bool_or(F.col("wide") | (F.size("jobs") == 0)), F.lit(False)).alias("upgrade"))
    return rows.join(F.broadcast(upgrade)).select("id", F.when(F.col("upgrade"), F.array_sort(F.array_union("jobs", F.array(F.lit("all"))))).otherwise(F.col("jobs")).alias("jobs"))


def is_fresh(ts: Column, ttl: Column, today: Column) -> Column:
    """Both fields are there, the limit is 1 to 365 days, and the age isn't over it."""
    return F.coalesce(ttl.between(1, 365) & (F.datediff(today, ts) <= ttl), F.lit(False))


def resolve_level(findings: DataFrame, config: DataFrame, rule: str = "rule") -> DataFrame:
    """findings with outcome, after the config (rule, setting: off, warn, error or required; a small table).

    off drops a finding; degraded evidence and notes are warnings at most; required stays an error in any case.
    """
    set_ = findings.join(config.select(F.col(rule), "setting"), rule, "left").withColumn("setting", F.coalesce("setting", "level"))
    capped = F.when(F.col("setting") == "required", "error").when((F.col("setting") == "note") | (F.col("fidelity") == "regex-degraded"), "warn").otherwise(F.col("setting"))
    return set_.filter("setting <> 'off'").withColumn("outcome", capped).drop("setting")


def issue_summary(findings: DataFrame, by: Sequence[str] = ("source",), strict: bool = False, level: str = "level") -> DataFrame:
    """Counts of errors, warnings and notes by source, and whether the source passes (strict: warnings fail too)."""
    n = lambda x: F.count_if(F.col(level) == x)
    out = findings.groupBy(*by).agg(n("E").alias("errors"), n("W").alias("warnings"), n("I").alias("notes"))
    return out.withColumn("passed", (F.col("errors") + (F.col("warnings") if strict else F.lit(0))) == 0)

