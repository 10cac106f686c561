"""Aggregations: rates, facets, roll-ups, merges, summaries, families, coverage, evaluation reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import last_wins
from .ranking import at_ranks, beside, nearest_rank, top_k


def pass_rate(df: DataFrame, *keys: str, passed: str = "pass") -> DataFrame:
    """passed, total and rate by key; a null counts as not passed."""
    return df.groupBy(*keys).agg(F.count_if(F.col(passed)).alias("passed"), F.count("*").alias("total")).withColumn("rate", F.col("passed") / F.col("total"))


def facet_counts(df: DataFrame, columns: Sequence[str], n: int = 20) -> DataFrame:
    """(facet, value, n): the n most frequent values of each column, all columns in one pass; ties by value."""
    sets = ", ".join(f"(`{c}`)" for c in columns)
    picks = " ".join(f"WHEN {sum(1 << (len(columns) - 1 - j) for j in range(len(columns)) if j != i)} THEN '{c}'" for i, c in enumerate(columns))
    values = " ".join(f"WHEN {sum(1 << (len(columns) - 1 - j) for j in range(len(columns)) if j != i)} THEN CAST(`{c}` AS string)" for i, c in enumerate(columns))
    counted = df.sparkSession.sql(
        f"SELECT CASE grouping_id() {picks} END AS facet, CASE grouping_id() {values} END AS value, count(*) AS n FROM {{df}} GROUP BY {', '.join(f'`{c}`' for c in columns)} GROUPING SETS ({sets})", df=df.select(*columns)
    )
    return top_k(counted, ["facet"], "n", n, ["value"])


def namespace_rollup(files: DataFrame, edges: DataFrame, exempt: DataFrame) -> DataFrame:
    """(domain, files, degraded, edges_out, edges_in, exempt): files(file, domain, fidelity), edges(src_domain, dst_domain), exempt(file)."""
    own = files.join(exempt.select("file").distinct().withColumn("_x", F.lit(1)), "file", "left").groupBy("domain").agg(F.count_distinct("file").alias("files"), F.count_if(F.col("fidelity") == "regex-degraded").alias("degraded"), F.count("_x").alias("exempt"))
    # one aggregation for both ends: an edge gives a row for each
    ends = edges.select(F.explode(F.array(F.struct(F.col("src_domain").alias("domain"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_domain").alias("domain"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    ends = ends.groupBy("domain").agg(F.sum("o").alias("edges_out"), F.sum("i").alias("edges_in"))
    return own.join(ends, "domain", "full").na.fill(0)


def edge_matrix(edges: DataFrame) -> DataFrame:
    """(src, dst, n, kinds) with kinds a sorted 'kind:n' list; dead targets, external ones and unknown domains have names of their own."""
    dst = F.when(F.coalesce("dead", F.lit(False)), "__dead__").when(F.coalesce("external", F.lit(False)), "external").otherwise(F.coalesce("dst_domain", F.lit("__other__")))
    by_kind = edges.groupBy(F.coalesce("src_domain", F.lit("__other__")).alias("src"), dst.alias("dst"), "kind").agg(F.count("*").alias("n"))
    return by_kind.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))


def degraded_rate(facts: DataFrame, unit: str = "unit", fidelity: str = "fidelity") -> DataFrame:
    """(unit, facts, degraded, rate) of the units with degraded facts."""
    out = facts.groupBy(unit).agg(F.count("*").alias("facts"), F.count_if(F.col(fidelity) == "regex-degraded").alias("degraded"))
    return out.filter("degraded > 0").withColumn("rate", F.col("degraded") / F.greatest("facts", F.lit(1)))


LISTED = 1000  # values of a key that are listed; the count tells how many there are


def _listed(df: DataFrame, key: str, value: str, name: str, most: int) -> DataFrame:
    """(key, name, n_name): the `most` least values of each key in order, and the number of all; no task holds more values of a key than that."""
    pairs = df.select(key, value).filter(F.col(value).isNotNull()).distinct()
    n = pairs.groupBy(key).agg(F.count("*").alias(f"n_{name}"))
    least = top_k(pairs.withColumn("_same", F.lit(0)), [key], "_same", most, [value], "_rank")
    return beside(n, least.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name)), [key])


def merge_components(df: DataFrame, key: str, source: str, depends: str, most: int = LISTED) -> DataFrame:
    """(key, sources, n_sources, depends_on, n_depends_on): one row a component, with the union of its sources and dependencies, sorted: the
    first `most` of each, and their numbers."""
    out = df.select(key).distinct()
    for value, name in ((source, "sources"), (depends, "depends_on")):
        out = beside(out, _listed(df, key, value, name, most), [key]).na.fill(0, [f"n_{name}"])
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out


def components(df: DataFrame, ref: str, value: str, order: str) -> DataFrame:
    """(ref, value): the first value that isn't null, in order."""
    return df.groupBy(ref).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def severity_summary(findings: DataFrame, levels: Sequence[str], level: str = "severity") -> DataFrame:
    """(severity, n, rank) with a row for each of the fixed levels, also those without a finding."""
    table = df_of(findings, [(x, i) for i, x in enumerate(levels)], f"{level} string, rank int")
    return table.join(findings.groupBy(level).agg(F.count("*").alias("n")), level, "left").na.fill(0, ["n"])


def scan_state(findings: DataFrame, scanned: int, failed: int) -> tuple[str, str]:
    """(completeness, presence): partial or complete, none or present."""
    return "partial" if failed else "complete", "none" if findings.isEmpty() else "present"


def df_of(like: DataFrame, rows: list, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


SEVERITY_LEVELS = ("critical", "high", "moderate", "low", "info")


def normalize_findings(reports: DataFrame, vulnerabilities: str = "vulnerabilities") -> DataFrame:
    """(source, name, severity, is_direct, range, via) from reports(source, vulnerabilities: map name -> struct); via without blanks, sorted."""
    rows = reports.select("source", F.explode(vulnerabilities).alias("name", "v"))
    via = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col("v.via"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))))
    severity = F.when(F.col("v.severity").isin(*SEVERITY_LEVELS), F.col("v.severity")).otherwise("info")
    return rows.select("source", "name", severity.alias("severity"), F.coalesce("v.isDirect", F.lit(False)).alias("is_direct"), F.col("v.range").alias("range"), via.alias("via"))


def table_fingerprint(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """One row (n, xor, sum): a fingerprint that doesn't depend on the order of rows; columns by name, nulls marked."""
    columns = sorted(c for c in df.columns if c not in ignore)
    row = F.xxhash64(*(F.xxhash64(F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00null"))) for c in columns))
    return df.select(row.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("sum"))


def is_fresh_artifact(a: DataFrame, b: DataFrame, ignore: Sequence[str] = ()) -> bool:
    """Whether two tables have the same rows, timestamps and such left out."""
    return table_fingerprint(a, ignore).first() == table_fingerprint(b, ignore).first()


# Prefixes that look like identifiers and aren't.
FAMILY_STOP = (
    "ISO UTF SHA MD RGB HSL IP TCP UDP HTTP HTTPS SQL PNG JPG JPEG GIF BMP PDF ZIP GPU CPU API URL URI JSON YAML XML HTML CSS CLI GUI IDE SDK CI CD IoU AR GT DTD MAE ONNX UI TDD BDD MDT "
    "DNA SARIF OPA AES RSA CVE RFC ECMA TLS SSL IEEE NIST PKCS OAEP PBKDF HMAC ECDH ECDSA AEAD GCM CBC CTR FNV GPL MIT BSD WPT TLA"
).split()


def token_families(docs: DataFrame, doc_id: str, text: str, pattern: str = r"(?<![\w-])([A-Z]{2,6}-?\d+[a-z]?)(?!\w)", prefix: str = r"^([A-Z]+)", stop: Sequence[str] = FAMILY_STOP, least: int = 2, sample: int = 5) -> DataFrame:
    """(prefix, tokens, hits, docs, sample) of identifier-like families with `least` distinct tokens or more."""
    found = docs.select(F.col(doc_id).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("token")).withColumn("prefix", F.regexp_extract("token", prefix, 1)).filter(~F.col("prefix").isin(*stop))
    # one row for each token first: a hot token is one row of a family
    by_token = found.groupBy("prefix", "token").agg(F.count("*").alias("hits"), F.count_distinct("doc").alias("docs"))
    shown = top_k(by_token.withColumn("_z", F.lit(0)), ["prefix"], "_z", sample, ["token"]).groupBy("prefix").agg(F.array_sort(F.collect_list("token")).alias("sample"))
    return by_token.groupBy("prefix").agg(F.count("*").alias("tokens"), F.sum("hits").alias("hits")).filter(F.col("tokens") >= least).join(shown, "prefix")


def collisions(definitions: DataFrame, key: str, site: str) -> DataFrame:
    """(key, sites) of ids that are defined at more than one site."""
    return definitions.groupBy(key).agg(F.count_distinct(site).alias("sites")).filter("sites > 1")


def ref_stats(definitions: DataFrame, references: DataFrame, namespace: str = "ns", key: str = "id", file: str = "file") -> DataFrame:
    """(ns, defs, refs, files, dangling, dead): references without a definition, definitions without a reference."""
    d, r = definitions.select(namespace, key).distinct(), references.select(namespace, key, file)
    used = r.groupBy(namespace, key).agg(F.count("*").alias("n"))
    both = d.withColumn("_d", F.lit(1)).join(used, [namespace, key], "full")
    out = both.groupBy(namespace).agg(F.count("_d").alias("defs"), F.coalesce(F.sum("n"), F.lit(0)).alias("refs"), F.coalesce(F.sum(F.when(F.col("_d").isNull(), F.col("n"))), F.lit(0)).alias("dangling"), F.count_if(F.col("n").isNull()).alias("dead"))
    return out.join(r.groupBy(namespace).agg(F.count_distinct(file).alias("files")), namespace, "left").na.fill(0, ["files"])


def label_index(definitions: DataFrame, references: DataFrame, key: str = "id", site: str = "site", most: int = LISTED) -> DataFrame:
    """(id, sites, n_sites, refs, dead) of every defined id; the first `most` sites are listed, and n_sites is their number."""
    sites = beside(definitions.select(key).distinct(), _listed(definitions, key, site, "sites", most), [key]).na.fill(0, ["n_sites"])
    sites = sites.withColumn("sites", F.coalesce("sites", F.array().cast(sites.schema["sites"].dataType)))
    return beside(sites, references.groupBy(key).agg(F.count("*").alias("refs")), [key]).na.fill(0, ["refs"]).withColumn("dead", F.col("refs") == 0)


def coverage_matrix(df: DataFrame, rows: DataFrame, columns: DataFrame, zero: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n, status): covered, empty, declared_zero or contradiction (declared zero, yet there).

    rows and columns are dimension tables whose product is the matrix that is asked for.
    """
    counts = df.groupBy(row, column).agg(F.count("*").alias("n"))
    cells = rows.select(row).distinct().join(columns.select(column).distinct())
    out = cells.join(counts, [row, column], "left").join(zero.select(row, column).distinct().withColumn("_zero", F.lit(True)), [row, column], "left").na.fill(0, ["n"])
    z = F.coalesce("_zero", F.lit(False))
    return out.select(row, column, "n", F.when(z & (F.col("n") > 0), "contradiction").when(z, "declared_zero").when(F.col("n") > 0, "covered").otherwise("empty").alias("status"))


def eval_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Evaluation by key over (oos, top1_hit, hit3, hit_any, abstain_ok, top1_score, n_picked, band_hit, ms).

    Null hits aren't hits, but their rows stay in the denominators. p50 and p95 take the index min(n-1, floor(n*f)).
    """
    inside = ~F.col("oos")
    hit = lambda c, where: F.count_if(where & F.coalesce(F.col(c), F.lit(False)))
    sums = [
        F.count_if(inside).alias("in_scope"),
        F.count_if(F.col("oos")).alias("out_of_scope"),
        hit("top1_hit", inside).alias("top1"),
        hit("hit3", inside).alias("top3"),
        hit("hit_any", inside).alias("hit_any"),
        hit("abstain_ok", F.col("oos")).alias("abstain_ok"),
        F.avg(F.when(inside, F.col("top1_score"))).alias("mean_in"),
        F.avg(F.when(F.col("oos"), F.col("top1_score"))).alias("mean_oos"),
        F.avg("n_picked").alias("mean_picked"),
        hit("band_hit", F.lit(True)).alias("band_hits"),
    ]
    out = rows.groupBy(*keys).agg(*sums)
    ranks = at_ranks(rows, "ms", keys, {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95)})
    return beside(out, ranks, keys)


def recall_report(rows: DataFrame, tier: str = "tier") -> DataFrame:
    """By tier over (emb_hit, kw_hit, top1_score): hits of each way, of either, of one alone, and max, median, min of the score."""
    e, k = F.coalesce("emb_hit", F.lit(False)), F.coalesce("kw_hit", F.lit(False))
    out = rows.groupBy(tier).agg(
        F.count("*").alias("n"), F.count_if(e).alias("emb"), F.count_if(k).alias("kw"), F.count_if(e | k).alias("either"), F.count_if(e & ~k).alias("emb_only"), F.count_if(k & ~e).alias("kw_only"),
        F.max("top1_score").alias("max_score"), F.min("top1_score").alias("min_score"),
    )
    middle = at_ranks(rows, "top1_score", [tier], {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.ceil((n - 1) / 2)})
    both = beside(out, middle, [tier]).withColumn("median_score", (F.col("_lo") + F.col("_hi")) / 2)
    return both.select(tier, "n", "emb", "kw", "either", "emb_only", "kw_only", "max_score", "median_score", "min_score")


def separability(rows: DataFrame, score: str = "top1_score") -> DataFrame:
    """One row: greatest and 95 % score out of scope, 5 % and mean score in scope, by the index rule of rank_percentile."""
    scored = rows.select("oos", F.col(score).alias("s")).filter("s IS NOT NULL")
    ranks = at_ranks(scored, "s", ["oos"], {"p95": nearest_rank(0.95), "p05": nearest_rank(0.05)})
    ranks = ranks.agg(F.max(F.when(F.col("oos"), F.col("p95"))).alias("oos_p95"), F.max(F.when(~F.col("oos"), F.col("p05"))).alias("in_p05"))
    out = scored.agg(F.max(F.when(F.col("oos"), F.col("s"))).alias("oos_max"), F.avg(F.when(~F.col("oos"), F.col("s"))).alias("in_mean"))
    return out.join(ranks).select("oos_max", "oos_p95", "in_p05", "in_mean")  # one row each


def class_counts(df: DataFrame, column: str = "class") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def corpus_metrics(files: DataFrame, gates: Mapping[str, float], sample: int = 5) -> DataFrame:
    """One row over files(file, parsed, fixture, edges, lines, name): parse rate (fixtures exempt), edges for 1000 lines,
    malformed names with a sorted sample, and passed, held against gates (parse_rate, edges_per_kloc, malformed)."""
    malformed = ~F.col("name").rlike(r"^[\w.$/-]+\z")
    head = files.agg(
        F.count_if(~F.col("fixture")).alias("files"), (F.count_if(~F.col("fixture") & F.col("parsed")) / F.greatest(F.count_if(~F.col("fixture")), F.lit(1))).alias("parse_rate"),
        (F.sum("edges") * 1000.0 / F.greatest(F.sum("lines"), F.lit(1))).alias("edges_per_kloc"), F.count_if(malformed).alias("malformed"),
    )
    shown = files.filter(malformed).select("name").distinct().orderBy("name").limit(sample).agg(F.array_sort(F.collect_list("name")).alias("malformed_sample"))
    ok = (F.col("parse_rate") >= gates.get("parse_rate", 0)) & (F.col("edges_per_kloc") >= gates.get("edges_per_kloc", 0)) & (F.col("malformed") <= gates.get("malformed", 1e18))
    return head.join(shown).withColumn("passed", ok)


def fixture_asserts(facts: DataFrame, specs: DataFrame) -> DataFrame:
    """(file, check, want, got, ok) for specs(file, min_imports, min_decls, max_malformed); a null limit isn't checked."""
    got = facts.groupBy("file").agg(F.count_if(F.col("kind") == "import").alias("imports"), F.count_if(F.col("kind") == "decl").alias("decls"), F.count_if(~F.col("name").rlike(r"^[\w.$/-]+\z")).alias("malformed"))
    both = specs.join(got, "file", "left").na.fill(0, ["imports", "decls", "malformed"])
    checks = F.array(
        F.struct(F.lit("min_imports").alias("check"), F.col("min_imports").cast("long").alias("want"), F.col("imports").alias("got"), (F.col("imports") >= F.col("min_imports")).alias("ok")),
        F.struct(F.lit("min_decls").alias("check"), F.col("min_decls").cast("long").alias("want"), F.col("decls").alias("got"), (F.col("decls") >= F.col("min_decls")).alias("ok")),
        F.struct(F.lit("max_malformed").alias("check"), F.col("max_malformed").cast("long").alias("want"), F.col("malformed").alias("got"), (F.col("malformed") <= F.col("max_malformed")).alias("ok")),
    )
    return both.select("file", F.explode(checks).alias("c")).select("file", "c.*").filter("want IS NOT NULL")


def topology_profile(files: DataFrame, inbound: DataFrame, path: str = "path") -> DataFrame:
    """(head, files, declared, ignored, no_inbound): by first segment; ignored where 80 % of the files or more declare."""
    seen = inbound.select(F.col("dst").alias(path)).distinct().withColumn("_in", F.lit(1))
    out = files.join(seen, path, "left").groupBy(F.split_part(path, F.lit("/"), F.lit(1)).alias("head")).agg(F.count("*").alias("files"), F.count_if(F.col("declares")).alias("declared"), F.count_if(F.col("_in").isNull()).alias("no_inbound"))
    return out.withColumn("ignored", F.col("declared") >= 0.8 * F.col("files"))


def registry_stats(df: DataFrame, layer: str, domain: str) -> DataFrame:
    """(facet, value, n): counts by layer and by domain, with an 'undeclared' bucket."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(name).alias("facet"), F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("undeclared")).alias("value")) for name, c in (("layer", layer), ("domain", domain))))).alias("f"))
    return rows.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def candidate_stats(df: DataFrame, today: Column, evidence: str = "evidence", opened: str = "opened_at") -> DataFrame:
    """One row: candidates, ready ones (evidence of 2 or more) and the greatest age in days."""
    return df.agg(F.count("*").alias("candidates"), F.count_if(F.col(evidence) >= 2).alias("ready"), F.max(F.datediff(today, F.col(opened))).alias("oldest_days"))


def normalize_packets(df: DataFrame) -> DataFrame:
    """Captured packets in one schema: header list to a map of lower-case names (a value object or a plain value; the last
    of a name counts), status 0 by default, kind response or fetch_error.

    df: (id, url, method, status, error, headers: array<struct<name, value, object: struct<value>>>).
    """
    pairs = F.transform(F.coalesce("headers", F.array().cast(dict(df.dtypes)["headers"])), lambda h: F.struct(F.lower(h["name"]).alias("name"), F.coalesce(h["object"]["value"], h["value"]).alias("value")))
    kind = F.when(F.col("error").isNotNull(), "fetch_error").otherwise("response")
    return df.select("id", kind.alias("kind"), "url", F.upper("method").alias("method"), F.coalesce("status", F.lit(0)).alias("status"), last_wins(F.filter(pairs, lambda p: p["name"].isNotNull()), "name", "value").alias("headers"), "error")

