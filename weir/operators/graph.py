"""Contracts over typed edges: projection to domains, rule families, exemptions, reachability, degrees."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import domain_of, match_any
from .tables import cut

FINDING = ["rule", "severity", "unit", "file", "expect", "observed"]


def _finding(df: DataFrame, rule: str, severity: str, unit: Column, expect: str, observed: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), unit.cast("string").alias("unit"), F.lit(expect).alias("expect"), observed.cast("string").alias("observed"))


def edges(facts: DataFrame, rules: Sequence[tuple[str, str]], src: str = "file", dst: str = "to") -> DataFrame:
    """facts that are edges, with src_domain and dst_domain; dead and external targets and unknown domains have names of their own."""
    out = facts.filter(F.col(dst).isNotNull())
    to = F.when(F.coalesce("dead", F.lit(False)), "__dead__").when(F.coalesce("external", F.lit(False)), "external").otherwise(F.coalesce(domain_of(F.col(dst), rules), F.lit("__other__")))
    return out.withColumns({"src_domain": F.coalesce(domain_of(F.col(src), rules), F.lit("__other__")), "dst_domain": to})


def dead_edges(edges_: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return _finding(edges_.filter(F.coalesce("dead", F.lit(False))), "dead-edge", "error", F.col(src), "an existing target", F.col(dst))


MAX_RULES = 1000


def _policy(rules: DataFrame) -> list:
    """The rows of a rule table, which is a policy of at most MAX_RULES rows."""
    rows = rules.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"a policy has at most {MAX_RULES} rules")
    return rows


def _labelled(edges_: DataFrame, tests: Sequence[tuple[str, Column]]) -> DataFrame:
    """edges with each rule whose test holds; edges that no rule meets go before anything is made of them."""
    if not tests:
        return edges_.withColumn("rule", F.lit(None).cast("string")).limit(0)
    some = reduce(lambda a, b: a | b, (test for _, test in tests))
    return edges_.filter(some).withColumn("rule", F.explode(F.array_compact(F.array(*(F.when(test, F.lit(rule)) for rule, test in tests)))))


def rule_forbidden(edges_: DataFrame, rules: DataFrame) -> DataFrame:
    """edges with the rule that forbids them: rules(rule, src_domain, dst_domain, via); a null field fits all. The rules, a policy,
    become expressions: no join."""
    tests = []
    for r in _policy(rules):
        fits = F.lit(True)
        for column, value in (("src_domain", r["src_domain"]), ("dst_domain", r["dst_domain"]), ("kind", r["via"])):
            fits = fits if value is None else fits & (F.col(column) == value)
        tests.append((r["rule"], fits))
    return _labelled(edges_, tests)


def rule_allowed(edges_: DataFrame, rules: DataFrame) -> DataFrame:
    """edges with the rule whose list they leave: rules(rule, from_in, to_in, via), all arrays of strings.

    An edge of one of the kinds in via (null or empty: of any kind) from a domain in from_in has to lead to a domain in to_in, also
    where it stays inside its domain. Independent of forbidden pairs.
    """
    isin = lambda column, values: F.coalesce(F.col(column).isin(*values), F.lit(False)) if values else F.lit(False)
    return _labelled(edges_, [(r["rule"], isin("src_domain", r["from_in"]) & ~isin("dst_domain", r["to_in"]) & (isin("kind", r["via"]) if r["via"] else F.lit(True))) for r in _policy(rules)])


def rule_required(units: DataFrame, edges_: DataFrame, unit: str, good: Column) -> DataFrame:
    """Units without a qualifying live edge; edges has the unit column."""
    live = edges_.filter(good & ~F.coalesce("dead", F.lit(False))).select(unit).distinct()
    return units.select(unit).distinct().join(live, unit, "left_anti")


def rule_covered(units: DataFrame, edges_: DataFrame, unit: str = "unit", dst: str = "dst", good: Column | None = None) -> DataFrame:
    """Units that no (qualifying) edge points to."""
    seen = (edges_ if good is None else edges_.filter(good)).select(F.col(dst).alias(unit)).distinct()
    return units.select(unit).distinct().join(seen, unit, "left_anti")


def rule_isolated(units: DataFrame, edges_: DataFrame, unit: str = "unit", src: str = "src", dst: str = "dst") -> DataFrame:
    """Units that ought to stand alone and have an edge, with the number of their edges (a loop counts once)."""
    ends = edges_.select(F.explode(F.array_distinct(F.array(src, dst))).alias(unit))
    # counted first: what meets the units is a row for each end, not for each edge
    return ends.groupBy(unit).agg(F.count("*").alias("edges")).join(units.select(unit).distinct(), unit, "left_semi")


def _walk(e: DataFrame, frontier: DataFrame, seen: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame | None]:
    """(seen, None) where the walk from the frontier has ended, else (seen, frontier) after so many rounds."""
    for _ in range(rounds):
        frontier = cut(e.join(frontier, F.col("_s") == F.col("n")).select(F.col("_d").alias("n")).distinct().join(seen, "n", "left_anti"))
        if frontier.isEmpty():
            return seen, None
        seen = seen.unionByName(frontier)
    return seen, frontier


def _contract(e: DataFrame, fixed: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(edges, owed): the graph without what decides nothing, and tables of (n, by), in the order in which nodes went: such a
    node is reached if one of its `by` is.

    Edges into fixed nodes (those that are reached) and out of nodes that nothing leads to go. Ends, which lead nowhere, go next. Then a chain of
    nodes with one edge in and one out becomes one edge: each of its nodes finds the node before the chain by doubling its
    pointer, so that the rounds grow with the logarithm of the chain's length. Rings that nothing leads into go as well.
    """
    node = lambda c: F.col(c).alias("n")
    e = e.filter("_s <> _d").join(fixed.withColumnRenamed("n", "_d"), "_d", "left_anti")
    e = cut(e.join(e.select(node("_d")).unionByName(fixed).distinct().withColumnRenamed("n", "_s"), "_s", "left_semi").select("_s", "_d"))
    ends = e.select(node("_d")).distinct().join(e.select(node("_s")).distinct(), "n", "left_anti")
    owed = e.join(ends.withColumnRenamed("n", "_d"), "_d").select(F.col("_d").alias("n"), F.col("_s").alias("by"))
    e = cut(e.join(ends.withColumnRenamed("n", "_d"), "_d", "left_anti").select("_s", "_d"))
    one_out = e.groupBy(node("_s")).agg(F.count("*").alias("k")).filter("k = 1").select("n").join(fixed, "n", "left_anti")
    one_in = e.groupBy(node("_d")).agg(F.count("*").alias("k"), F.min("_s").alias("by")).filter("k = 1").select("n", "by")
    inner = cut(one_in.join(one_out, "n", "left_semi"))
    names = cut(inner.select("n"))
    at, left, last = inner, inner.join(names.withColumnRenamed("n", "by"), "by", "left_semi").count(), -1
    for _ in range(inner.count().bit_length() + 1):
        if not left or left == last:
            break
        further = at.select(F.col("n").alias("by"), F.col("by").alias("_far"))
        at = cut(at.join(further, "by", "left").select("n", F.coalesce("_far", "by").alias("by")))
        left, last = at.join(names.withColumnRenamed("n", "by"), "by", "left_semi").count(), left
    known = at.join(names.withColumnRenamed("n", "by"), "by", "left_anti").select("n", "by")  # the rest are rings
    outer = e.join(names.withColumnRenamed("n", "_s"), "_s", "left_anti").join(names.withColumnRenamed("n", "_d"), "_d", "left_anti").select("_s", "_d")
    bridges = e.join(names.withColumnRenamed("n", "_d"), "_d", "left_anti").join(known.withColumnRenamed("n", "_s"), "_s").select(F.col("by").alias("_s"), "_d")
    return cut(outer.unionByName(bridges).distinct()), [cut(owed), cut(known)]


def reachable(edges_: DataFrame, roots: DataFrame, node: str = "node", src: str = "src", dst: str = "dst", rounds: int = 1000, walk: int = 8) -> DataFrame:
    """Nodes that can be reached from the roots (roots included).

    Each round joins the frontier with the edges and takes off what is known. A walk that goes on for `walk` rounds is
    followed by a contraction of what is left (see _contract), and so on, so that long chains and deep trees take rounds in the order of
    the logarithm of their depth; where a contraction takes less than a tenth of the edges, the walk goes on round by round.
    """
    e = cut(edges_.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).filter("_s IS NOT NULL AND _d IS NOT NULL").distinct())
    frontier = cut(roots.select(F.col(node).alias("n")).filter("n IS NOT NULL").distinct())
    seen, owed, n = frontier, [], None
    steps = walk
    while frontier is not None:
        seen, frontier = _walk(e, frontier, seen, min(steps, rounds))
        rounds -= steps
        if frontier is None:
            break
        if rounds <= 0:
            raise RuntimeError("not settled in the given number of rounds")
        seen = cut(seen)
        n = e.count() if n is None else n
        e, more = _contract(e, seen)
        left = e.count()
        owed += more
        steps = walk if left < 0.9 * n else rounds
        frontier, n = seen, left
    for table in reversed(owed):  # what went last decides what went before
        seen = cut(seen.unionByName(table.join(seen.withColumnRenamed("n", "by"), "by", "left_semi").select("n")).distinct())
    return seen.select(F.col("n").alias(node))


def rule_reachable(units: DataFrame, edges_: DataFrame, roots: DataFrame, unit: str = "unit", src: str = "src", dst: str = "dst") -> DataFrame:
    """Units in scope that can't be reached from the roots along live edges."""
    live = edges_.filter(~F.coalesce("dead", F.lit(False))) if "dead" in edges_.columns else edges_
    return units.select(unit).distinct().join(reachable(live, roots, unit, src, dst), unit, "left_anti")


def rule_attrs(units: DataFrame, path: str, must: Sequence[str] = (), must_not: Sequence[str] = ()) -> DataFrame:
    """(path, issue): a name that fits none of `must`, or one of `must_not`."""
    issues = F.array_compact(F.array(F.when(~match_any(F.col(path), must), "name_match") if must else F.lit(None).cast("string"), F.when(match_any(F.col(path), must_not), "name_not_match") if must_not else F.lit(None).cast("string")))
    return units.select(path, F.explode(issues).alias("issue"))


#: Families that no exemption silences.
NEVER_EXEMPT = ("forbidden", "allowed")


def apply_exemptions(findings: DataFrame, exemptions: DataFrame, globs: Sequence[tuple[str, str, str]] = (), family: str = "family", unit: str = "unit") -> DataFrame:
    """findings that no exemption silences: exemptions(unit, rule or null, reason) and globs (pattern, rule or '', reason).
    An exemption needs a reason; forbidden and allowed findings stay in any case."""
    kept = findings.filter(F.col(family).isin(*NEVER_EXEMPT))
    rest = findings.filter(~F.col(family).isin(*NEVER_EXEMPT))
    valid = exemptions.filter(F.coalesce(F.trim("reason"), F.lit("")) != "").select(F.col(unit), F.col("rule").alias("_r"))
    every = valid.filter("_r IS NULL").select(unit).distinct()
    one = valid.filter("_r IS NOT NULL").select(unit, F.col("_r").alias("rule")).distinct()
    rest = rest.join(every, unit, "left_anti").join(one, [unit, "rule"], "left_anti")
    for pattern, rule, reason in globs:
        if reason.strip():
            hit = match_any(F.col(unit), [pattern])
            rest = rest.filter(~(hit & (F.col("rule") == rule)) if rule else ~hit)
    return rest.select(*findings.columns).unionByName(kept)


def degrees(edges_: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, n_out, n_in): an edge gives a row for each end, aggregated once."""
    ends = edges_.select(F.explode(F.array(F.struct(F.col(src).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(dst).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def dependency_edges(resolved: DataFrame, packages: DataFrame) -> DataFrame:
    """(source, ref, depends_on): sorted and distinct, from resolved (source, path, dep_path) and packages (source, path, ref)."""
    refs = packages.select("source", "path", "ref")
    both = resolved.join(refs, ["source", "path"]).join(refs.select("source", F.col("path").alias("dep_path"), F.col("ref").alias("dep_ref")), ["source", "dep_path"])
    return both.groupBy("source", "ref").agg(F.array_sort(F.collect_set("dep_ref")).alias("depends_on"))
