"""Declarative data-quality contracts: table constraints, sources, proposals, audits, packages, candidates, ratchets, registries. Document classes are in docclass."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import valid_source
from .terms import match_term_table

def validate_table(df: DataFrame, constraints: Sequence[Mapping], key: str) -> DataFrame:
    """(key, rule, field, observed): required, enum (values), nonnegative, at_most (an SQL expression to hold), whole, matches.

    constraints: {rule, field, …}; all are judged in one pass. An unknown rule is an error.
    """
    checks = []
    for c in constraints:
        f = F.col(c["field"]) if "field" in c else None
        match c["rule"]:
            case "required":
                bad = f.isNull() | (F.trim(f.cast("string")) == "")
            case "enum":
                bad = f.isNotNull() & ~f.isin(*c["values"])
            case "nonnegative":
                bad = f < 0
            case "whole":
                bad = f.isNotNull() & (f != F.floor(f))
            case "matches":
                bad = f.isNotNull() & ~f.cast("string").rlike(c["pattern"])
            case "holds":
                bad = ~F.coalesce(F.expr(c["expr"]), F.lit(False))
            case other:
                raise ValueError(f"no such rule: {other}")
        observed = f.cast("string") if f is not None else F.lit(None).cast("string")
        checks.append(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(c.get("name", c["rule"])).alias("rule"), F.lit(c.get("field", c.get("expr"))).alias("field"), observed.alias("observed"))))
    return df.select(key, F.explode(F.array_compact(F.array(*checks))).alias("f")).select(key, "f.*")


def source_findings(sources: DataFrame, census: DataFrame, today: Column, url: str = "url", pin: str = "pin", path: str = "path", ttl: str = "ttl_days", checked: str = "checked") -> DataFrame:
    """(name, level, issue): E for a bad url or pin and for a missing file, W for a check past its time, I for a source without a limit."""
    both = sources.join(census.select(F.col(path)).distinct().withColumn("_there", F.lit(True)), path, "left")
    issues = F.array_compact(F.array(
        F.when(~valid_source(F.col(url), F.col(pin)), F.struct(F.lit("E").alias("level"), F.lit("invalid source or pin").alias("issue"))),
        F.when(F.col("_there").isNull(), F.struct(F.lit("E").alias("level"), F.lit("file missing").alias("issue"))),
        F.when(F.col(ttl).isNotNull() & (F.datediff(today, F.col(checked)) > F.col(ttl)), F.struct(F.lit("W").alias("level"), F.lit("check overdue").alias("issue"))),
        F.when(F.col(ttl).isNull(), F.struct(F.lit("I").alias("level"), F.lit("no limit").alias("issue"))),
    ))
    return both.select("name", F.explode(issues).alias("i")).select("name", "i.*")


def proposal_findings(df: DataFrame, today: Column, statuses: Sequence[str], types: Sequence[str], id_col: str = "id", stem: str = "stem", status: str = "status", type_col: str = "type", review: str = "review_after", header: str | None = None) -> DataFrame:
    """(stem, level, issue) of proposals, known by the stem of their file.

    E: no header (where a column of that name says so), an id that isn't the stem, no status, an unknown status or type; W: pending, with
    a review day (yyyy-mm-dd; other forms aren't judged) before today. An absent id or type is in order.
    """
    said = lambda c: F.col(c).cast("string")
    there = F.lit(True) if header is None else F.coalesce(F.col(header), F.lit(False))
    there_and = lambda test: there & F.coalesce(test, F.lit(False))
    late = (said(status) == "pending") & said(review).rlike(r"^\d{4}-\d{2}-\d{2}\z") & (said(review) < F.date_format(today, "yyyy-MM-dd"))
    issues = [
        ("E", "no_header", ~there), ("E", "id_not_stem", there_and((said(id_col) != "") & (said(id_col) != said(stem)))), ("E", "no_status", there & (F.coalesce(said(status), F.lit("")) == "")),
        ("E", "status", there_and((said(status) != "") & ~said(status).isin(*statuses))), ("E", "type", there_and((said(type_col) != "") & ~said(type_col).isin(*types))), ("W", "overdue", there_and(late)),
    ]
    return _issues(df, [stem], issues)


def _issues(df: DataFrame, keys: Sequence[str], issues: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(keys, level, issue) for each test that holds."""
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(level).alias("level"), F.lit(issue).alias("issue"))) for level, issue, test in issues)))
    return df.select(*keys, F.explode(found).alias("i")).select(*keys, "i.*")


@dataclass(frozen=True)
class AuditSetup:
    domains: Sequence[str]
    states: Sequence[str]
    types: Sequence[str]
    verbs: Sequence[str]
    registered: Sequence[str] | None = None  # domains that the project has declared; None: not judged
    max_age: int = 90  # days that a document may stay proposed or provisional
    strict: bool = False  # a document without a domain is an error
    decisions: str = r"(?i)(?:^|/)adr/"  # paths of decision records, whose state stands in their text


def audit_docs(docs: DataFrame, references: DataFrame, pointers: DataFrame, today: Column, setup: AuditSetup, key: str = "id") -> DataFrame:
    """(id, level, issue) over docs(id, domain, state, type, binding, dynamics array, since), references(src, dst) and
    pointers(id, target, there): what a document marks as landed, with the file that it names and whether it exists.

    orphan: no domain. domain, state, type, binding, dynamics: outside their vocabularies (binding is 0 to 4). undeclared_domain,
    no_state (not asked of decision records), ageing (proposed or provisional for more than max_age days), no_since. landed_without_target,
    landed_missing. inversion: a normative document refers to one that is proposed or provisional.
    """
    c, known = F.col, lambda test: F.coalesce(test, F.lit(False))
    has = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) != ""
    waiting = known(c("state").isin("proposed", "provisional"))
    issues = [
        ("E" if setup.strict else "W", "orphan", ~has("domain")), ("W", "domain", has("domain") & ~known(c("domain").isin(*setup.domains))),
        ("E", "state", has("state") & ~known(c("state").isin(*setup.states))), ("E", "type", has("type") & ~known(c("type").isin(*setup.types))),
        ("E", "binding", c("binding").isNotNull() & ~known(c("binding").cast("string").rlike(r"^[0-4]\z"))),
        ("I", "no_state", has("domain") & ~has("state") & ~known(c(key).cast("string").rlike(setup.decisions))),
        ("W", "ageing", waiting & known(F.datediff(today, c("since")) > setup.max_age)), ("I", "no_since", waiting & c("since").isNull()),
    ]
    if setup.registered is not None:
        issues.append(("W", "undeclared_domain", known(c("domain").isin(*setup.domains)) & ~known(c("domain").isin(*setup.registered))))
    own = _issues(docs, [key], issues)
    verbs = docs.select(key, F.explode("dynamics").alias("_v")).filter(~c("_v").isin(*setup.verbs)).select(key).distinct().select(key, F.lit("E").alias("level"), F.lit("dynamics").alias("issue"))
    landed = _issues(pointers, [key], [("W", "landed_without_target", ~has("target")), ("E", "landed_missing", has("target") & ~known(c("there")))])
    inverted = (
        references.join(docs.filter("state = 'normative'").select(c(key).alias("src")), "src", "left_semi")
        .join(docs.filter("state IN ('proposed', 'provisional')").select(c(key).alias("dst")), "dst", "left_semi")
        .select(c("src").alias(key)).distinct().select(key, F.lit("W").alias("level"), F.lit("inversion").alias("issue"))
    )
    return own.unionByName(verbs).unionByName(landed).unionByName(inverted)


def package_findings(packages: DataFrame, links: DataFrame, min_name: int = 3, min_description: int = 20, max_description: int = 400, max_lines: int = 500, families: Sequence[tuple[str, str, str]] = (), files: DataFrame | None = None) -> DataFrame:
    """(folder, level, issue) over packages(folder, name, description, body), known by their folder, and links(folder, target,
    dead, outside). name, description and body are null where the package's text has none; body is what follows the header.

    families: (ending of a folder, file that such packages have, heading in their body); files: (folder, file) of what packages have.
    """
    c, text = F.col, F.coalesce(F.col("description"), F.lit(""))
    what = text.rlike(r"[\u4e00-\u9fa5]|(?i)\b(?:use|create|when|for)\b")
    triggers = text.rlike(r"(?i)触发词|trigger|使用") | (F.size(F.split(text, "[,，、;；]")) >= 3)
    own = _issues(packages, ["folder"], [
        ("E", "no_name", c("name").isNull()), ("E", "name", c("name").isNotNull() & (~c("name").rlike(r"^[a-z0-9]+(-[a-z0-9]+)*\z") | (F.length("name") < min_name))), ("E", "name_not_folder", c("name").isNotNull() & (c("name") != c("folder"))),
        ("E", "no_description", c("description").isNull()), ("E", "description_short", c("description").isNotNull() & (F.length(text) < min_description)), ("W", "description_long", F.length(text) > max_description),
        ("W", "no_purpose", c("description").isNotNull() & ~what), ("W", "no_triggers", c("description").isNotNull() & ~triggers), ("W", "path_in_description", text.rlike(r"[A-Z]:\\|/home/|/Users/")),
        ("W", "body_too_long", F.size(F.split(F.coalesce("body", F.lit("")), "\n")) > max_lines),
    ])
    bad = _issues(links, ["folder"], [("E", "dead_link", F.coalesce("dead", F.lit(False))), ("E", "link_outside", F.coalesce("outside", F.lit(False)))]).distinct()
    out = own.unionByName(bad)
    for ending, file, heading in families:
        family = packages.filter(c("folder").endswith(ending))
        if files is not None:
            out = out.unionByName(family.join(files.filter(c("file") == file).select("folder").distinct(), "folder", "left_anti").select("folder", F.lit("W").alias("level"), F.lit("family_file").alias("issue")))
        titled = F.coalesce(c("body").rlike(rf"(?m)^##?\s*.*{re.escape(heading)}"), F.lit(False))
        out = out.unionByName(family.filter(~titled).select("folder", F.lit("I").alias("level"), F.lit("family_section").alias("issue")))
    return out


CANDIDATE_FIELDS = ("domain", "path", "rationale", "graduation", "opened_at")


def candidate_findings(df: DataFrame, today: Column, key: str = "id", name: str = "name", evidence: str = "evidence", required: Sequence[str] = CANDIDATE_FIELDS, opened: str = "opened_at", domains: Sequence[str] = (), packages: DataFrame | None = None, paths: DataFrame | None = None, max_age: int = 90, ready: int = 2) -> DataFrame:
    """(id, level, issue) of candidates. E: name (not lower-case words with dashes), missing:FIELD, no_evidence (0 pieces), duplicate
    (the name of a candidate with a smaller id), name_taken (by packages(name)); W: domain (unknown, where domains are given),
    path_exists (in paths(path)), opened_unreadable; I: ready (evidence reaches the threshold), ageing (more than max_age days)."""
    c, text = F.col, lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    first = df.filter(c(name).isNotNull()).groupBy(name).agg(F.min(key).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select(name, "_first")
    both = df.join(first, name, "left")
    for other, column, flag in ((packages, name, "_taken"), (paths, "path", "_there")):
        seen = None if other is None else other.select(column).distinct().withColumn(flag, F.lit(True))
        both = both.withColumn(flag, F.lit(False)) if seen is None else both.join(seen, column, "left")
    days = F.datediff(today, F.try_to_date(text(opened)))
    issues = [
        ("E", "name", ~text(name).rlike(r"^[a-z0-9]+(-[a-z0-9]+)*\z")), *(("E", f"missing:{f}", text(f) == "") for f in required), ("E", "no_evidence", c(evidence) == 0),
        ("E", "duplicate", c("_first") < c(key)), ("E", "name_taken", c("_taken")), ("W", "path_exists", c("_there")), ("W", "opened_unreadable", days.isNull()),
        ("I", "ready", c(evidence) >= ready), ("I", "ageing", days > max_age),
    ]
    if domains:
        issues.append(("W", "domain", (text("domain") != "") & ~c("domain").isin(*domains)))
    return _issues(both, [key], [(level, issue, F.coalesce(test, F.lit(False))) for level, issue, test in issues])


def index_findings(names: DataFrame, docs: DataFrame, doc_id: str, text: str, name: str = "name") -> DataFrame:
    """(term, docs): how many texts mention each registered name, as it is, between borders; 0 is a finding. Names are rows (see terms)."""
    hits = match_term_table(docs, names, doc_id, text, name, flex=False).groupBy("term").agg(F.count("*").alias("docs"))
    return names.select(F.col(name).cast("string").alias("term")).distinct().join(hits, "term", "left").na.fill(0, ["docs"])


def free_rows(lines: DataFrame, names: DataFrame, marker: str, doc: str = "doc_id", name: str = "name") -> DataFrame:
    """(doc, line_no, cell): table rows whose first cell names something that isn't registered, and that no marker excuses.

    A cell may name several things, split by '/'; what follows a bracket in a name doesn't count. Header rows (those before a
    line of dashes) and cells without an ASCII letter are no items.
    """
    cell = F.trim(F.regexp_replace(F.regexp_extract("line", r"^\s*\|([^|]*)\|", 1), "[`*]", ""))
    rows = lines.filter(F.col("line").rlike(r"^\s*\|")).withColumns({"cell": cell, "_next": F.lead("line").over(Window.partitionBy(doc).orderBy("line_no"))})
    rows = rows.filter(F.col("cell").rlike("[A-Za-z]") & ~F.coalesce(F.col("_next").rlike(r"^\s*\|[\s:|-]+\|\s*$"), F.lit(False)) & ~F.col("line").rlike(marker))
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[(（].*$", "")))
    named = rows.select(doc, "line_no", "cell", F.explode(F.filter(F.transform(F.split("cell", "/"), key), lambda x: x != "")).alias("_n"))
    known = names.select(key(F.col(name)).alias("_n")).distinct()
    return named.join(known, "_n", "left_anti").select(doc, "line_no", "cell").distinct()


def finding_id(gate: Column, file: Column, match: Column) -> Column:
    """Identity of a finding without its line and without its plain text."""
    return F.sha1(F.concat(gate, F.lit("|"), file, F.lit("|"), F.coalesce(F.sha1(match), F.lit(""))))


def fresh_findings(findings: DataFrame, baseline: DataFrame | None, gate: str = "gate", file: str = "file", match: str = "match") -> DataFrame:
    """findings with id; only those that the baseline (id) doesn't have. Without a baseline all are fresh."""
    out = findings.withColumn("id", finding_id(F.col(gate), F.col(file), F.col(match)))
    return out if baseline is None else out.join(baseline.select("id").distinct(), "id", "left_anti")
