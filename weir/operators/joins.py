"""Joins: terms in texts, baselines, drift, resolution by candidates, intervals, labels as of a later row, coverage."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import flex_pattern, flex_variants
from ..functions.text import norm_key
from .ranking import seconds, top_k
from .scans import ranged, run_over
from .terms import phrase_hits


def match_terms(docs: DataFrame, terms: Sequence[str], doc_id: str, text: str) -> DataFrame:
    """(doc, term) where a text holds a term with its inflected forms between word borders.

    A text is cut into words once, within its row; the terms that begin with one of them are looked up in a small map, and
    only these are verified by pattern. Terms without a word of letters or digits are tried on every text. No text is
    copied or shuffled: what leaves a row is its pairs.
    """
    by_first: dict[str, list[str]] = {}
    loose = []
    for t in dict.fromkeys(terms):
        firsts = {m.group() for v in flex_variants(t) for m in [re.match(r"[a-z0-9]+", v.lower())] if m}
        for f in firsts:
            by_first.setdefault(f, []).append(t)
        if not firsts:
            loose.append(t)
    rows = docs.select(F.col(doc_id).alias("doc"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    found = F.array_compact(F.array(*(F.when(F.col("low").rlike(flex_pattern(t)), F.lit(t)) for t in loose))) if loose else F.array().cast("array<string>")
    if by_first:
        pair = lambda t: F.struct(F.lit(t).alias("term"), F.lit(flex_pattern(t)).alias("pattern"))
        table = F.create_map(*(x for f, ts in by_first.items() for x in (F.lit(f), F.array(*map(pair, ts)))))
        rows = rows.withColumn("firsts", F.array_intersect(F.regexp_extract_all("low", F.lit("([a-z0-9]+)"), F.lit(1)), F.array(*map(F.lit, by_first))))
        rows = rows.withColumn("tried", F.array_distinct(F.flatten(F.transform("firsts", lambda f: table[f]))))
        found = F.concat(found, F.expr("transform(filter(tried, x -> low rlike x.pattern), x -> x.term)"))
    return rows.select("doc", F.explode(found).alias("term"))


def fresh_only(df: DataFrame, text: str, *known: tuple[DataFrame, str], kind: str = "collapse") -> DataFrame:
    """Rows whose normalised text is in none of the known tables."""
    out = df.withColumn("_key", norm_key(F.col(text), kind))
    for other, column in known:
        out = out.join(other.select(norm_key(F.col(column), kind).alias("_key")).filter("_key IS NOT NULL").distinct(), "_key", "left_anti")
    return out.drop("_key")


def compare_baseline(current: DataFrame, base: DataFrame, key: str = "id", passed: str = "pass") -> DataFrame:
    """(id, state): regression, fixed, known_miss, pass, new_pass, new_miss or gone."""
    both = current.select(key, F.col(passed).alias("now"), F.lit(True).alias("here")).join(base.select(key, F.col(passed).alias("was"), F.lit(True).alias("there")), key, "full")
    state = (
        F.when(F.col("here").isNull(), "gone")
        .when(F.col("there").isNull(), F.when(F.col("now"), "new_pass").otherwise("new_miss"))
        .when(F.col("was") & ~F.col("now"), "regression")
        .when(~F.col("was") & F.col("now"), "fixed")
        .when(~F.col("now"), "known_miss")
        .otherwise("pass")
    )
    return both.select(key, state.alias("state"))


def snapshot_drift(before: DataFrame, now: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, change): missing, added or changed; equal rows are left out. Nulls equal nulls."""
    a = before.select(*keys, F.struct(*columns).alias("a"))
    b = now.select(*keys, F.struct(*columns).alias("b"))
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, list(keys), "full").select(*keys, change.alias("change")).filter("change IS NOT NULL")


def coverage(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side): uncovered (expected, not there) and foreign (there, not expected)."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.join(a, list(keys), "left_anti").withColumn("side", F.lit("uncovered")).unionByName(a.join(e, list(keys), "left_anti").withColumn("side", F.lit("foreign")))


def resolve_mentions(mentions: DataFrame, declarations: DataFrame, name: str = "name", symbol: str = "symbol", show: int = 8) -> DataFrame:
    """mentions with symbol (of a unique hit), ambiguous and candidates (the first `show`, sorted); names without a hit go.
    No more than `show` symbols of a name are put together, and two at least."""
    first = top_k(declarations.select(name, symbol).filter(F.col(symbol).isNotNull()).distinct().withColumn("_s", F.lit(0)), [name], "_s", max(2, show), [symbol])
    by_name = first.groupBy(name).agg(F.array_sort(F.collect_list(symbol)).alias("all"))
    found = mentions.join(by_name, name)
    one = F.size("all") == 1
    return found.withColumns({"symbol": F.when(one, F.col("all")[0]), "ambiguous": ~one, "candidates": F.when(~one, F.slice("all", 1, show))}).drop("all")


def normal_path(path: Column) -> Column:
    """A relative path without '.' and empty segments and with '..' taken back."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    back = lambda a: (F.size(a) > 0) & (F.coalesce(F.get(a, F.size(a) - 1), F.lit("")) != "..")
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & back(a), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.array_join(folded, "/")


def resolve_links(links: DataFrame, files: DataFrame, src: str = "src", target: str = "target", path: str = "path") -> DataFrame:
    """links with resolved and dead: the target beside the source file is tried first, then from the root."""
    folder = F.regexp_replace(F.col(src), r"[^/]*$", "")
    clean = F.split_part(F.col(target), F.lit("#"), F.lit(1))
    tried = links.withColumns({"_a": normal_path(F.when(clean.startswith("/"), clean).otherwise(F.concat(folder, clean))), "_b": normal_path(clean)})
    known = files.select(F.col(path).alias("_p")).distinct()
    tried = tried.join(known.withColumnRenamed("_p", "_pa"), F.col("_a") == F.col("_pa"), "left").join(known.withColumnRenamed("_p", "_pb"), F.col("_b") == F.col("_pb"), "left")
    return tried.withColumn("resolved", F.coalesce("_pa", "_pb")).withColumn("dead", F.col("resolved").isNull()).drop("_a", "_b", "_pa", "_pb")


SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.js", "/index.mjs")


def resolve_specs(imports: DataFrame, files: DataFrame, src: str = "src", spec: str = "spec", path: str = "path", suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """imports with resolved, dead and external: relative modules lose ?query and #part, then suffixes are tried in order,
    also with a .js ending written as .ts; other modules are external."""
    clean = F.regexp_replace(spec, r"[?#].*$", "")
    base = normal_path(F.concat(F.regexp_replace(src, r"[^/]*$", ""), clean))
    # files say which modules they could stand for, with the number of the try that finds them: a module is one row throughout
    at = F.col("_p")
    stands = [F.when(at.endswith(s), F.struct(at.substr(F.lit(1), F.length(at) - len(s)).alias("_base"), F.lit(k).alias("_k"))) for k, s in enumerate(suffixes)]
    ts, js = r"\.(m|c)?ts$", r"\.(m|c)?js$"
    for fits, stood in ((at.rlike(ts), F.regexp_replace(at, ts, ".$1js")), (~at.rlike(js), at)):
        stands.append(F.when(fits, F.struct(stood.alias("_base"), F.lit(len(suffixes)).alias("_k"))))
    known = files.select(F.col(path).alias("_p")).distinct().select("_p", F.explode(F.array_compact(F.array(*stands))).alias("_s"))
    known = known.groupBy("_s._base").agg(F.min_by("_p", "_s._k").alias("resolved"))
    external = ~F.col(spec).startswith(".")
    rows = imports.withColumns({"external": external, "_base": F.when(~external, base)})
    return rows.join(known, "_base", "left").withColumn("dead", ~F.col("external") & F.col("resolved").isNull()).drop("_base")


def resolve_nested(packages: DataFrame, dependencies: DataFrame, path: str = "path", name: str = "dep") -> DataFrame:
    """(source, path, dep, dep_path): the nearest enclosing node_modules folder that has the dependency."""
    chain = F.split(path, "(?<=.)(?:^|/)(?=node_modules/)")
    prefixes = F.concat(F.transform(F.sequence(F.size(chain), F.lit(1), F.lit(-1)), lambda n: F.concat(F.array_join(F.slice(chain, 1, n), "/"), F.lit("/"))), F.array(F.lit("")))
    tries = dependencies.select("source", path, name, F.posexplode(F.transform(prefixes, lambda p: F.concat(p, F.lit("node_modules/"), F.col(name)))).alias("_k", "dep_path"))
    known = packages.select("source", F.col(path).alias("dep_path")).distinct()
    return tries.join(known, ["source", "dep_path"]).groupBy("source", path, name).agg(F.min_by("dep_path", "_k").alias("dep_path"))


def slice_windows(actions: DataFrame, flows: DataFrame, quiet_s: float, baseline: DataFrame | None = None, part: str = "session", start: str = "start_ts", ts: str = "ts", same: Sequence[str] = ("url", "method"), ranges: int | None = None) -> DataFrame:
    """(action, flow) pairs: flows after an action's start up to its quiet point, less what the baseline has.

    The quiet point of an action is the last flow before the first gap of quiet_s after the start. Actions and flows are
    scanned together (see scans; a session may be of any size): a flow begins a burst if no flow came within quiet_s before it, bursts are
    numbered by a running sum, and an action's burst is that of the next flow. Actions join their burst's flows; no theta join.
    """
    kind = dict(actions.dtypes)["action_id"]
    both = flows.withColumns({"_flow": F.struct(*flows.columns), "_t": F.col(ts), "_late": F.lit(0), "action_id": F.lit(None).cast(kind)}).select(part, "_t", "_late", "_flow", "action_id")
    # a flow at the very start is before the action
    both = both.unionByName(actions.select(part, F.col(start).alias("_t"), F.lit(1).alias("_late"), "action_id"), allowMissingColumns=True)
    order, of_flow = ["_t", "_late"], F.when(F.col("_flow").isNotNull(), F.col("_t"))
    near = run_over(ranged(both, [part], order, ranges), [part], order, before={"_prev": of_flow}, after={"_next": of_flow})
    gap = lambda at: F.coalesce(seconds(at) - seconds(F.col("_prev")) >= quiet_s, F.lit(True))
    burst = run_over(near, [part], order, running={"_burst": F.when(F.col("_flow").isNotNull() & gap(F.col("_t")), 1)})
    opened = burst.filter("_flow IS NULL AND _next IS NOT NULL").select(part, "action_id", F.col("_t").alias(start), (F.col("_burst") + gap(F.col("_next")).cast("int")).alias("_burst"))
    found = opened.join(burst.filter("_flow IS NOT NULL").select(part, "_burst", "_flow"), [part, "_burst"]).filter(F.col(f"_flow.{ts}") > F.col(start))
    found = found.select(part, "action_id", start, *(f"_flow.{c}" for c in flows.columns if c != part))
    return found if baseline is None else found.join(baseline.select(*same).distinct(), list(same), "left_anti")


def forward_label(turns: DataFrame, n: int, part: str = "conv_id", order: str = "turn", role: str = "role", label: str = "label", ranges: int | None = None) -> DataFrame:
    """User turns with the first label within the next n turns, before the next user turn. A conversation may be of any size (see scans)."""
    user = F.coalesce(F.col(role) == "user", F.lit(False))
    rows = run_over(ranged(turns, [part], [order], ranges), [part], [order], running={"_seg": user.cast("int"), "_at": F.lit(1)}).filter("_seg > 0")
    rows = run_over(rows, [part], [order], before={"_head": F.when(user, F.col("_at"))})
    picked = rows.filter(~user & F.col(label).isNotNull() & (F.col("_at") - F.col("_head") <= n)).groupBy(part, "_seg").agg(F.min_by(label, "_at").alias("actual"))
    return rows.filter(user).join(picked, [part, "_seg"], "left").select(*turns.columns, "actual")


def reuse_scores(current: DataFrame, prior: DataFrame, key: str = "id", text: str = "text", score: str = "score") -> DataFrame:
    """current with a prior score, by id, else by the squeezed text (the least prior id of a text counts), and its way."""
    by_id = prior.groupBy(key).agg(F.first(score).alias("_s1"))
    keyed = prior.withColumn("_key", norm_key(F.col(text), "squeeze"))
    by_text = keyed.groupBy("_key").agg(F.min_by(score, key).alias("_s2"))
    out = current.withColumn("_key", norm_key(F.col(text), "squeeze")).join(by_id, key, "left").join(by_text, "_key", "left")
    way = F.when(F.col("_s1").isNotNull(), "id").when(F.col("_s2").isNotNull(), "text").otherwise("new")
    return out.withColumns({score: F.coalesce("_s1", "_s2"), "reused": way}).drop("_key", "_s1", "_s2")


def rescore(ranked: DataFrame, labels: DataFrame, key: str = "id", top: str = "top") -> DataFrame:
    """Ranked rows (id, top: names in rank order) judged anew against labels (id, wanted, oos); out of scope: null."""
    both = ranked.join(labels.select(key, "wanted", "oos"), key)
    judge = lambda hit: F.when(F.col("oos") | (F.size("wanted") == 0), F.lit(None).cast("boolean")).otherwise(hit)
    return both.withColumns({"top1_hit": judge(F.coalesce(F.array_contains("wanted", F.get(top, F.lit(0))), F.lit(False))), "hit3": judge(F.arrays_overlap("wanted", F.slice(top, 1, 3)))})


def annotate_fidelity(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """findings with the fidelity of their evidence: the fact at (file, line), else any of the file (the weakest)."""
    rank = F.when(F.col("fidelity") == "regex-degraded", 0).when(F.col("fidelity") == "syntactic", 1).otherwise(2)
    at = facts.filter("line IS NOT NULL").groupBy("file", "line").agg(F.min_by("fidelity", rank).alias("_f1"))
    whole = facts.groupBy("file").agg(F.min_by("fidelity", rank).alias("_f2"))
    return findings.drop("fidelity").join(at, ["file", "line"], "left").join(whole, "file", "left").withColumn("fidelity", F.coalesce("_f1", "_f2")).drop("_f1", "_f2")


def dangling_parents(df: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows whose parent names no row."""
    return df.filter(F.col(parent).isNotNull()).join(df.select(F.col(key).alias(parent)).distinct(), parent, "left_anti")


def reconcile_index(index: DataFrame, files: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, issue): a column that differs, dangling (index only) or unregistered (file only)."""
    a = index.select(key, F.struct(*columns).alias("a"))
    b = files.select(key, F.struct(*columns).alias("b"))
    issues = F.when(F.col("b").isNull(), F.array(F.lit("dangling"))).when(F.col("a").isNull(), F.array(F.lit("unregistered"))).otherwise(F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(f"{c}_differs")) for c in columns))))
    return a.join(b, key, "full").select(key, F.explode(issues).alias("issue"))


LEAST_STEM = 6  # characters: shorter ones are words that mean much else


def mention_coverage(units: DataFrame, corpus: DataFrame, exempt: DataFrame, unit: str = "unit", text: str = "text") -> DataFrame:
    """(unit, status): covered, uncovered, exempt, stale_exemption or exemption_without_reason.

    A unit is covered if the corpus has, as a run of words, the unit as it is, its last path segment, or that segment
    without its extension (of LEAST_STEM characters or more). Stretches of a text's words are matched with whole forms (see terms).
    """
    base = F.element_at(F.split(F.lower(unit), "/"), -1)
    stem = F.regexp_replace(base, r"\.[^.]+$", "")
    forms = units.select(unit, F.explode(F.array_distinct(F.array_compact(F.array(F.lower(unit), base, F.when(F.length(stem) >= LEAST_STEM, stem))))).alias("_form"))
    hit = forms.join(phrase_hits(corpus, forms, text, "_form"), "_form").select(unit).distinct().withColumn("_hit", F.lit(True))
    out = units.select(unit).distinct().join(hit, unit, "left").join(exempt.select(unit, F.coalesce("reason", F.lit("")).alias("_why")), unit, "left")
    why, got = F.col("_why"), F.coalesce("_hit", F.lit(False))
    status = F.when(why.isNotNull() & (F.trim(why) == ""), "exemption_without_reason").when(why.isNotNull() & got, "stale_exemption").when(why.isNotNull(), "exempt").when(got, "covered").otherwise("uncovered")
    return out.select(unit, status.alias("status"))


def orphans(observed: DataFrame, registered: DataFrame, path: str = "path") -> DataFrame:
    """Observed paths that aren't registered and have no registered path below them; names starting with . or _ are exempt."""
    reg = registered.select(path).distinct()
    parts = F.split(path, "/")
    above = reg.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias(path)).distinct()
    seen = observed.select(path).distinct().filter(~F.element_at(F.split(path, "/"), -1).rlike("^[._]"))
    return seen.join(reg, path, "left_anti").join(above, path, "left_anti")
