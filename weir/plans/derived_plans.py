"""Queries of operators whose inputs Spark derives from the given tables first: nested records, Markdown, code, lockfiles, ledgers, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..operators import checks
from ..operators import contracts as C
from ..operators import decide as D
from ..operators import docclass as DC
from ..operators import extract as E
from ..operators import filters as L
from ..operators import graph as G
from ..operators import joins as J
from ..operators import ranking as R
from ..operators.snapshots import diff_snapshot, write_snapshot
from ..operators.tables import fresh_dir
from ..sources import io as IO
from ..streaming import ledgers as T
from .kit import Book, t
from .rule_plans import RULES, scores_sql
from .table_plans import WS_PARTS, documents

book = Book()
query = book.query
QUERIES, ORACLES = book.queries, book.oracles


def written(df: DataFrame, name: str) -> str:
    """df as JSON lines in a new folder of the shared directory."""
    path = fresh_dir(df.sparkSession, name)
    df.write.json(path)
    return path


# sources and sinks


@query("SELECT CAST(doc_id AS VARCHAR) AS id, lang AS domain, 'A' AS tier, CASE WHEN quality = 1 THEN 'keep' END AS wanted, false AS oos FROM labels JOIN documents USING (doc_id)")
def s1_read_cases(spark, sf_dir):
    lab = t(spark, sf_dir, "labels").join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    cases = lab.select(F.col("doc_id").cast("string").alias("id"), F.lit("q").alias("query"), F.struct(F.col("lang").alias("domain"), F.when(F.col("quality") == 1, F.array(F.lit("keep"))).alias("skills")).alias("expect"), F.lit("A").alias("tier"))
    out = L.with_expectation(IO.read_cases(spark, written(cases, "cases")))
    return out.select("id", F.col("expect.domain").alias("domain"), "tier", F.get("wanted", F.lit(0)).alias("wanted"), "oos")


@query("SELECT count(*) FILTER (event_id % 10 <> 0) AS good, count(*) FILTER (event_id % 10 = 0) AS malformed FROM events")
def s2_read_events(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_type").alias("event"), F.col("value").alias("duration_ms"))).alias("j"), "event_id")
    path = fresh_dir(spark, "events")
    e.select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "j")).otherwise(F.col("j")).alias("value")).write.text(path)
    good, report = IO.read_events(spark, path)
    return good.agg(F.count("*").alias("good")).join(report.select("malformed"))


def _facts(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    extra = F.struct(F.concat(F.lit("p"), "l_partkey").alias("to"), (F.col("l_quantity") > 49).alias("dead"))
    return li.select(F.lit(1).alias("v"), F.concat(F.lit("o"), "l_orderkey").alias("unit"), F.lit("link").alias("kind"), F.concat(F.lit("p"), "l_partkey").alias("name"), F.concat(F.lit("o"), "l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", "regex-degraded").otherwise("exact").alias("fidelity"), extra.alias("extra"))


@query("SELECT 'o' || l_orderkey AS unit, count(*) AS facts, count(*) FILTER (l_quantity > 49) AS dead FROM lineitem GROUP BY 1")
def s3_read_facts(spark, sf_dir):
    facts = IO.read_facts(spark, written(_facts(spark, sf_dir), "facts"))
    return facts.groupBy("unit").agg(F.count("*").alias("facts"), F.count_if("extra.dead").alias("dead"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'link' AS kind FROM lineitem UNION ALL SELECT 'decl' FROM part) GROUP BY 1")
def s4_merge_facts(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.lit(1).alias("v"), F.concat(F.lit("p"), "p_partkey").alias("unit"), F.lit("decl").alias("kind"), F.col("p_name").alias("name"), F.lit("parts").alias("file"), F.lit("exact").alias("fidelity"))
    return IO.merge_facts(_facts(spark, sf_dir).drop("extra"), p).groupBy("kind").agg(F.count("*").alias("n"))


def _grow(root: str):
    """Writes a folder for each nation and, in it, a file for each supplier: its comment key as text, empty for every fifth; links to
    every seventh, of which every third is dead; and a folder that is to be ignored."""
    import os

    def run(batches):
        for batch in batches:
            for key, nation in zip(batch["s_suppkey"], batch["s_nationkey"], strict=True):
                folder = f"{root}/n{nation}/deep"
                os.makedirs(f"{folder}/.git", exist_ok=True)
                for name, text in ((f"s{key}.TXT", "" if key % 5 == 0 else f"supplier {key}"), (f".git/s{key}", "x")):
                    with open(f"{folder}/{name}", "w") as f:
                        f.write(text)
                if key % 7 == 0 and not os.path.lexists(f"{folder}/l{key}"):
                    os.symlink(f"s{key}.TXT" if key % 21 else "gone", f"{folder}/l{key}")
            yield batch[["s_suppkey"]]

    return run


@query("""
WITH s AS (SELECT s_suppkey AS k, 'n' || s_nationkey || '/deep' AS folder FROM supplier)
SELECT folder || '/s' || k || '.TXT' AS path, '.txt' AS ext, CASE WHEN k % 5 = 0 THEN 0 ELSE length('supplier ' || k) END AS bytes, 'file' AS kind, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS BOOLEAN) AS dead FROM s
UNION ALL SELECT folder || '/l' || k, '', 0, 'link', CASE WHEN k % 21 <> 0 THEN folder || '/s' || k || '.TXT' END, k % 21 = 0 FROM s WHERE k % 7 = 0
UNION ALL SELECT DISTINCT unnest([folder, string_split(folder, '/')[1]]), '', 0, 'dir', NULL, NULL FROM s
""")
def s6_file_census(spark, sf_dir):
    root = fresh_dir(spark, "census")
    local = root.removeprefix("file://") if root.startswith("file:///") else root.removeprefix("file:")
    if "://" in local:
        raise ValueError("the tree of this query needs a shared folder that is mounted")
    t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").repartition("s_nationkey").mapInPandas(_grow(local), "s_suppkey long").count()
    return IO.file_census(spark, root)


@query("SELECT 'o' || l_orderkey AS file, l_linenumber AS line, 'p' || l_partkey AS name FROM lineitem")
def s8_write_facts(spark, sf_dir):
    path = fresh_dir(spark, "dump")
    IO.write_facts(_facts(spark, sf_dir), path)
    return IO.read_facts(spark, path).select("file", F.col("line").cast("int").alias("line"), "name")


@query("SELECT CAST(ts AS DATE) AS day, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd-1' END AS batch, count(*) AS n FROM events GROUP BY 1, 2")
def s9_append_events(spark, sf_dir):
    """Two batches; the first is repeated, a second one of the second's name and an attempt that was never committed leave nothing."""
    path = fresh_dir(spark, "ledger")
    e = t(spark, sf_dir, "events").select("event_id", F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("event"))
    even, odd = e.filter("event_id % 2 = 0").drop("event_id"), e.filter("event_id % 2 = 1").drop("event_id")
    done = [IO.append_events(even, path, "even"), IO.append_events(even, path, "even"), IO.append_events(odd, path, "odd-1"), IO.append_events(even, path, "odd-1")]
    even.withColumn("day", F.to_date("timestamp")).write.partitionBy("day").json(f"{path}/attempt={'0' * 32}")
    if done != [True, False, True, False]:
        raise AssertionError(f"batches were appended otherwise than once: {done}")
    return IO.read_ledger(spark, path).groupBy("day", "batch").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, quality = 1 AS pass FROM labels")
def s10_snapshot(spark, sf_dir):
    return IO.snapshot(t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("pass")), "id", "pass")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 1500 = 3 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 1500 = 3 OR o_orderkey % 1000 = 7 AND o_orderstatus IS NOT NULL
UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 1200 = 5
""")
def u1_snapshot_diff(spark, sf_dir):
    """Orders against their snapshot, after some were removed, some changed and some added."""
    path, k = fresh_dir(spark, "snapshot"), F.col("o_orderkey")
    base = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    write_snapshot(base, path, ["o_orderkey"])
    now = base.filter(k % 1500 != 3).withColumn("o_orderstatus", F.when(k % 1000 == 7, "changed").otherwise(F.col("o_orderstatus")))
    return diff_snapshot(now.unionByName(base.filter(k % 1200 == 5).withColumn("o_orderkey", -k)), path, ["o_orderkey"])


def _lockfiles(spark, sf_dir):
    """A lockfile for each supplier: its parts as packages, every third one nested in the part before it."""
    pairs = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    path = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("node_modules/p"), F.col("l_partkey") - 1, F.lit("/node_modules/p"), "l_partkey")).otherwise(F.concat(F.lit("node_modules/p"), "l_partkey"))
    dev = F.col("l_partkey") % 7 == 0
    deps = F.create_map(F.concat(F.lit("p"), F.col("l_partkey") + 1), F.lit("*"))
    pack = F.struct((F.col("l_partkey") % 5).cast("string").alias("version"), dev.alias("dev"), F.lit(False).alias("optional"), F.lit("h").alias("integrity"), deps.alias("dependencies"))
    packages = pairs.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("source")).agg(F.map_from_entries(F.collect_list(F.struct(path.alias("k"), pack.alias("v")))).alias("packages"))
    return packages.select("source", F.lit(3).alias("lockfileVersion"), "packages")


PACKS = """WITH p AS (SELECT DISTINCT 's' || l_suppkey AS source, l_partkey AS k FROM lineitem),
q AS (SELECT source, k, CASE WHEN k % 3 = 0 THEN 'node_modules/p' || (k - 1) || '/node_modules/p' || k ELSE 'node_modules/p' || k END AS path, 'p' || k || '@' || (k % 5) AS ref FROM p WHERE k % 7 <> 0),
r AS (SELECT a.source, a.path, a.ref, b.path AS dep_path, b.ref AS dep_ref FROM q a JOIN q b ON a.source = b.source AND b.k = a.k + 1 AND (b.k % 3 <> 0 OR b.path = a.path || '/node_modules/p' || b.k))
"""


@query(PACKS + "SELECT source, path, ref FROM q")
def s11_lockfile_packages(spark, sf_dir):
    return IO.lockfile_packages(_lockfiles(spark, sf_dir)).select("source", "path", "ref")


def _resolved(spark, sf_dir):
    packages = IO.lockfile_packages(_lockfiles(spark, sf_dir))
    return packages, J.resolve_nested(packages, packages.select("source", "path", F.explode("dependencies").alias("dep")))


@query(PACKS + "SELECT source, path, dep_path FROM r")
def j11_resolve_nested(spark, sf_dir):
    return _resolved(spark, sf_dir)[1].select("source", "path", "dep_path")


@query(PACKS + "SELECT source, ref, string_agg(DISTINCT dep_ref, ',' ORDER BY dep_ref) AS depends_on FROM r GROUP BY 1, 2")
def g13_dependency_edges(spark, sf_dir):
    packages, resolved = _resolved(spark, sf_dir)
    return G.dependency_edges(resolved, packages).select("source", "ref", F.array_join("depends_on", ",").alias("depends_on"))


# decisions


def _decisions(spark, sf_dir):
    d = documents(spark, sf_dir)
    action = F.when(F.col("doc_id") % 3 == 0, "handoff").when(F.col("doc_id") % 3 == 1, "ask").otherwise("dispatch")
    return d.select("doc_id", F.when(F.col("n_chars") % 2 == 0, "none").otherwise("law").alias("domain"), action.alias("action"), F.when(F.col("n_chars") % 5 == 0, "high").otherwise("low").alias("confidence"), F.array(F.when(F.col("n_chars") % 4 == 0, "lexical_fallback: x@1.00").otherwise("domain_selected: law")).alias("reasons"))


@query("SELECT doc_id FROM documents WHERE (n_chars % 2 = 0 AND doc_id % 3 = 0) OR (doc_id % 3 = 1 AND n_chars % 4 = 0)")
def p9_suspicious(spark, sf_dir):
    return L.suspicious(_decisions(spark, sf_dir)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 2 OR n_chars % 5 <> 0")
def p10_weak_decisions(spark, sf_dir):
    return L.weak_decisions(_decisions(spark, sf_dir)).select("doc_id")


@query("SELECT doc_id AS id, concat_ws(',', CASE WHEN quality = 1 THEN 'a' END, CASE WHEN toxic = 1 THEN 'b' END) AS wanted, quality = 0 AS oos FROM labels")
def p12_with_expectation(spark, sf_dir):
    expect = F.struct(F.when(F.col("quality") == 0, "none").alias("domain"), F.lit(None).cast("string").alias("action"), F.when(F.col("quality") == 1, F.array(F.lit("a"))).alias("skills"), F.when(F.col("toxic") == 1, F.array(F.lit("b"))).alias("anySkills"))
    out = L.with_expectation(t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), expect.alias("expect")))
    return out.select("id", F.array_join("wanted", ",").alias("wanted"), "oos")


# texts


def _markdown(spark, sf_dir):
    """Documents as Markdown: a header block, a heading for each line, a link to the source."""
    lines = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("^[A-Za-z]{2}")), lambda x: F.concat(F.lit("## "), F.regexp_extract(x, "^([A-Za-z]+)", 1)))
    body = F.concat(F.lit("---\n## not a heading\nlang: "), F.coalesce("lang", F.lit("-")), F.lit("\nsource: "), "source", F.lit("\n---\n> Based on: "), "source", F.lit(".md\n\n"), F.array_join(lines, "\n"), F.lit("\nsee [it]("), "source", F.lit(".md) and [that][s]\n[s]: ../x/"), "source", F.lit(".md\n[it]: it.md\n[It][] or [s], `[c](code.md)`, [e](http://x.y/z), [a](#top)\n```\n[no](fenced.md)\n```\n"))
    return documents(spark, sf_dir).select("doc_id", body.alias("text"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS items, sum(length(regexp_extract(line, '^([A-Za-z]+)', 1))) AS chars FROM l WHERE regexp_matches(line, '^[A-Za-z]{2}') GROUP BY 1")
def x10_toc_items(spark, sf_dir):
    items = E.toc_items(E.lines_of(_markdown(spark, sf_dir), "doc_id", "text", fences=True))
    name = lambda x: F.length(F.regexp_extract(x, r"\(#(.*)\)$", 1))
    return items.select("doc_id", F.size("items").cast("long").alias("items"), F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + name(x)).alias("chars"))


@query("SELECT doc_id, coalesce(lang, '-') AS lang, source, source || '.md' AS based_on, 1 AS relations FROM documents")
def x11_doc_headers(spark, sf_dir):
    out = E.doc_headers(_markdown(spark, sf_dir), "doc_id", "text")
    return out.select("doc_id", F.col("frontmatter")["lang"].alias("lang"), F.col("frontmatter")["source"].alias("source"), F.col("blockquote")["Based on"].alias("based_on"), F.size("relations").alias("relations"))


@query("SELECT doc_id, unnest([source || '.md', '../x/' || source || '.md', 'it.md', '../x/' || source || '.md']) AS target, unnest(['inline', 'reference', 'collapsed', 'shortcut']) AS style FROM documents")
def x13_extract_links(spark, sf_dir):
    return E.extract_links(E.lines_of(_markdown(spark, sf_dir), "doc_id", "text", fences=True)).select("doc_id", "target", "style")


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS review_after, CAST(o_orderdate AS DATE) <= DATE '1998-01-01' AS due FROM orders")
def x20_due_reviews(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("# t\n> review-after: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\n")).alias("text"))
    return E.due_reviews(o, F.lit("1998-01-01").cast("date"), "id", "text")


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS z, replace(p_brand, '#', '') AS b FROM part)
SELECT k AS doc_id, unnest([1, 3, 3, 4, 7]) AS line_no, unnest(['import', 'import', 'decl', 'decl', 'decl']) AS kind, unnest(['./m' || z || '.js', 'r-' || b, 'x' || z, 'K' || k, 'f' || k]) AS name FROM p WHERE k % 3 = 0
UNION ALL SELECT k, unnest([1, 5, 6, 7]), unnest(['import', 'import', 'decl', 'decl']), unnest(['os.m' || z, 'pkg.' || b, 'f' || k, 'K' || k]) FROM p WHERE k % 3 = 1
UNION ALL SELECT k, unnest([1, 3, 4]), unnest(['decl', 'import', 'import']), unnest(['Get-X' || k, './lib' || z || '.ps1', 'M' || b]) FROM p WHERE k % 3 = 2
""")
def x25_code_facts(spark, sf_dir):
    """A program for each part, of three languages, with what looks like a fact inside comments and strings."""
    k, z, b = F.col("p_partkey"), F.col("p_size"), F.replace("p_brand", F.lit("#"), F.lit(""))
    fill = lambda program: reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), kv[1].cast("string")), (("<k>", k), ("<z>", z), ("<b>", b)), F.lit(program))
    programs = {
        "js": "import a from './m<z>.js'\n// import b from 'no'\nconst x<z> = require(\"r-<b>\")\nexport class K<k> {}\n/* function no() {}\nclass No {} */\nasync function f<k>() {}\n",
        "python": "import os.m<z>\n\"\"\"\nimport no\n\"\"\"\nfrom pkg.<b> import c  # import no\nasync def f<k>():\nclass K<k>:\n",
        "powershell": "function Get-X<k> {}\n<# function No {} #>\n. ./lib<z>.ps1\nImport-Module M<b>\n",
    }
    parts = t(spark, sf_dir, "part")
    out = [E.code_facts(parts.filter(k % 3 == i).select(k.alias("doc_id"), fill(program).alias("text")), "doc_id", "text", lang) for i, (lang, program) in enumerate(programs.items())]
    return reduce(DataFrame.unionByName, out)


@query("SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'fetch_error' ELSE 'response' END AS kind, CASE WHEN event_id % 2 = 0 THEN 200 ELSE 0 END AS status, CAST(user_id AS VARCHAR) AS who, event_type AS a FROM events")
def x32_normalize_packets(spark, sf_dir):
    header = lambda n, v, o: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"), F.struct(o.cast("string").alias("value")).alias("object"))
    null = F.lit(None).cast("string")
    headers = F.array(header("X-Who", F.col("user_id"), null), header("A", F.lit("first"), null), header("a", null, F.col("event_type")))
    e = t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("u").alias("url"), F.lit("get").alias("method"), F.when(F.col("event_id") % 2 == 0, 200).alias("status"), F.when(F.col("event_type") == "error", "net").alias("error"), headers.alias("headers"))
    return A.normalize_packets(e).select("id", "kind", "status", F.col("headers")["x-who"].alias("who"), F.col("headers")["a"].alias("a"))


@query("SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who FROM events")
def x33_cookie_map(spark, sf_dir):
    c = F.concat(F.lit("who=0; kind = "), "event_type", F.lit(";; who="), "user_id", F.lit(" ;flag"))
    return t(spark, sf_dir, "events").select("event_id", X.cookie_map(c).alias("m")).select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["who"].alias("who"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 = 3 THEN NULL ELSE CASE WHEN p_partkey IS NULL THEN NULL ELSE 'lib/p' || l_partkey || '.ts' END END AS resolved, l_partkey % 4 = 3 AS external, l_partkey % 4 <> 3 AND p_partkey IS NULL AS dead FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON p_partkey = l_partkey")
def j10_resolve_specs(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("src/m.js").alias("src"), F.when(F.col("l_partkey") % 4 == 3, F.concat(F.lit("p"), "l_partkey")).otherwise(F.concat(F.lit("../lib/./p"), "l_partkey", F.lit(".js?v#x"))).alias("spec"))
    files = t(spark, sf_dir, "part").filter("p_size > 10").select(F.concat(F.lit("lib/p"), "p_partkey", F.lit(".ts")).alias("path"))
    return J.resolve_specs(li, files).select("l_orderkey", "l_linenumber", "l_partkey", "resolved", "external", "dead")


@query("""
WITH f AS (SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 2 END AS r FROM lineitem), a AS (SELECT k, line, min(r) AS r FROM f GROUP BY 1, 2), w AS (SELECT k, min(r) AS r FROM f GROUP BY 1)
SELECT o_orderkey AS k, CASE coalesce(a.r, w.r) WHEN 0 THEN 'regex-degraded' WHEN 2 THEN 'exact' END AS fidelity FROM orders LEFT JOIN a ON a.k = o_orderkey AND a.line = o_orderkey % 7 + 1 LEFT JOIN w ON w.k = o_orderkey
""")
def j16_annotate_fidelity(spark, sf_dir):
    facts = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", "regex-degraded").otherwise("exact").alias("fidelity"))
    findings = t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("line"))
    return J.annotate_fidelity(findings, facts).select(F.col("file").cast("long").alias("k"), "fidelity")


@query("SELECT p_brand AS source, 'p' || p_partkey AS name, CASE WHEN p_size > 25 THEN 'high' ELSE 'info' END AS severity, p_size % 2 = 0 AS is_direct, CASE WHEN p_name <= p_type THEN p_name || ',' || p_type ELSE p_type || ',' || p_name END AS via FROM part WHERE p_name <> p_type")
def a11_normalize_findings(spark, sf_dir):
    v = F.struct(F.when(F.col("p_size") > 25, "high").otherwise("odd").alias("severity"), F.when(F.col("p_size") % 2 == 0, F.lit(True)).alias("isDirect"), F.lit("<2").alias("range"), F.array(F.col("p_type"), F.lit(" "), F.col("p_name"), F.col("p_type")).alias("via"))
    reports = t(spark, sf_dir, "part").filter("p_name <> p_type").groupBy(F.col("p_brand").alias("source")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("p"), "p_partkey").alias("k"), v.alias("v")))).alias("vulnerabilities"))
    return A.normalize_findings(reports).select("source", "name", "severity", "is_direct", F.array_join("via", ",").alias("via"))


@query("WITH f AS (SELECT l_suppkey AS k, count(*) FILTER (l_returnflag = 'R') AS i, count(*) FILTER (l_returnflag = 'A') AS d FROM lineitem GROUP BY 1) SELECT s_suppkey AS k, 'min_imports' AS check, coalesce(i, 0) >= 200 AS ok FROM supplier LEFT JOIN f ON k = s_suppkey UNION ALL SELECT s_suppkey, 'min_decls', coalesce(d, 0) >= 150 FROM supplier LEFT JOIN f ON k = s_suppkey")
def a25_fixture_asserts(spark, sf_dir):
    facts = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.when(F.col("l_returnflag") == "R", "import").when(F.col("l_returnflag") == "A", "decl").otherwise("link").alias("kind"), F.lit("n").alias("name"))
    specs = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.lit(200).alias("min_imports"), F.lit(150).alias("min_decls"), F.lit(None).cast("int").alias("max_malformed"))
    return A.fixture_asserts(facts, specs).select(F.col("file").alias("k"), "check", "ok")


# contracts


FIELD_SPEC = [
    {
        "class": "c", "match": {"path": ["**"]}, "header": "error",
        "fields": {"flag": {"vocab": ["A"], "tolerate": ["N"]}, "id": {"equalsFilenameStem": True, "pattern": "^[0-9]+-"}, "ship": {"pattern": "^199[0-6]"}},
        "conditional": [
            {"when": {"flag": "A"}, "check": {"ship": {"lt-date": "today"}}, "level": "warn", "msg": "{field} of {when.flag} is over"},
            {"when": {"flag": {"notIn": ["N"]}, "status": {"notIn": ["O"]}}, "require": ["note", "owner"], "msg": "{when.status} needs {field}"},
            {"when": {"id": "odd"}, "check": {"ship": {"lt-date": "1994-01-01"}}},
        ],
    }
]


def _line_findings(spark, sf_dir):
    """Lines as documents: a header where there is quantity enough, an id that is odd for some, an owner or an empty note for others."""
    li = t(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    pairs = F.array_compact(F.array(
        pair("flag", F.col("l_returnflag")), pair("id", F.when(F.col("l_tax") > 0.07, "odd").otherwise(key)), pair("ship", F.date_format("l_shipdate", "yyyy-MM-dd")), pair("status", F.col("l_linestatus")),
        F.when(F.col("l_quantity") > 40, pair("note", F.lit(""))), F.when(F.col("l_quantity") > 30, pair("owner", F.lit("me"))),
    ))
    docs = li.select(F.concat(F.lit("x/"), key, F.lit(".md")).alias("rel"), F.when(F.col("l_quantity") > 5, F.map_from_entries(pairs)).alias("fields"))
    return DC.docclass_findings(docs, FIELD_SPEC, F.lit("1995-01-01").cast("date"))


LINE_DOCS = "WITH d AS (SELECT 'x/' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '.md' AS rel, l_returnflag AS flag, l_tax > 0.07 AS odd, CAST(l_shipdate AS DATE) AS ship, l_linestatus AS status, l_quantity AS q, l_quantity > 5 AS there FROM lineitem)"


@query(LINE_DOCS + """SELECT rel, 'vocab' AS rule, 'flag' AS field FROM d WHERE there AND flag NOT IN ('A', 'N') UNION ALL SELECT rel, 'stem', 'id' FROM d WHERE there AND odd
UNION ALL SELECT rel, 'pattern', 'id' FROM d WHERE there AND odd UNION ALL SELECT rel, 'pattern', 'ship' FROM d WHERE there AND (ship < DATE '1990-01-01' OR ship >= DATE '1997-01-01')""")
def c3_field_rules(spark, sf_dir):
    return _line_findings(spark, sf_dir).filter("rule IN ('vocab', 'pattern', 'stem')").select("rel", "rule", "field")


@query(LINE_DOCS + """SELECT rel, 'conditional-check' AS rule, 'warn' AS level, 'ship' AS field, 'ship of A is over' AS message FROM d WHERE there AND flag = 'A' AND ship < DATE '1995-01-01'
UNION ALL SELECT rel, 'conditional', 'error', 'note', status || ' needs note' FROM d WHERE there AND flag = 'A' AND status <> 'O' UNION ALL SELECT rel, 'conditional', 'error', 'owner', status || ' needs owner' FROM d WHERE there AND flag = 'A' AND status <> 'O' AND q <= 30
UNION ALL SELECT rel, 'conditional-check', 'error', 'ship', 'ship is over' FROM d WHERE there AND odd AND ship < DATE '1994-01-01'""")
def c4_conditionals(spark, sf_dir):
    return _line_findings(spark, sf_dir).filter("rule LIKE 'conditional%'").select("rel", "rule", "level", "field", "message")


@query(LINE_DOCS + "SELECT rel, 'error' AS level FROM d WHERE NOT there")
def c5_missing_header(spark, sf_dir):
    return _line_findings(spark, sf_dir).filter("rule = 'header'").select("rel", "level")


@query(r"""
WITH s AS (SELECT page_id, starts_with(url, 'https://') AND NOT contains(url, '?') AND len(list_filter(string_split(regexp_extract(url, '^[^:]*://[^/?#]*/?([^?#]*)', 1), '/'), lambda x: x <> '')) >= 2 AS ok FROM pages)
SELECT page_id AS name, 'E' AS level, 'invalid source or pin' AS issue FROM s WHERE NOT ok UNION ALL SELECT page_id, 'E', 'file missing' FROM s WHERE page_id % 4 = 0 UNION ALL SELECT page_id, 'W', 'check overdue' FROM s WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'I', 'no limit' FROM s WHERE page_id % 3 <> 0
""")
def c9_source_findings(spark, sf_dir):
    p = t(spark, sf_dir, "pages")
    sources = p.select(F.col("page_id").alias("name"), "url", F.lit("2024-01-01").alias("pin"), F.col("page_id").cast("string").alias("path"), F.when(F.col("page_id") % 3 == 0, 30).alias("ttl_days"), F.lit("2024-01-01").cast("date").alias("checked"))
    census = p.filter("page_id % 4 <> 0").select(F.col("page_id").cast("string").alias("path"))
    return C.source_findings(sources, census, F.lit("2024-06-01").cast("date"))


AUDITED = """
WITH d AS (SELECT CASE WHEN c_custkey % 6 = 0 THEN 'adr/' ELSE 'd/' END || c_custkey AS id, c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'odd' WHEN 2 THEN 'edge' ELSE 'core' END AS domain,
  CASE c_custkey % 5 WHEN 0 THEN 'proposed' WHEN 1 THEN 'provisional' WHEN 2 THEN 'weird' WHEN 4 THEN 'normative' END AS state FROM customer),
o AS (SELECT a.id, a.state, o_orderkey AS o, b.state AS other FROM orders JOIN d a ON a.k = o_custkey LEFT JOIN d b ON b.k = (o_custkey * 7 + o_orderkey) % (SELECT count(*) FROM customer))
"""


@query(AUDITED + """
SELECT id, 'E' AS level, 'orphan' AS issue FROM d WHERE domain IS NULL UNION ALL SELECT id, 'W', 'domain' FROM d WHERE domain = 'odd' UNION ALL SELECT id, 'W', 'undeclared_domain' FROM d WHERE domain = 'edge' UNION ALL SELECT id, 'E', 'state' FROM d WHERE state = 'weird'
UNION ALL SELECT id, 'E', 'type' FROM d WHERE k % 9 = 0 UNION ALL SELECT id, 'E', 'binding' FROM d WHERE k % 10 = 0 UNION ALL SELECT id, 'E', 'dynamics' FROM d WHERE k % 8 = 0 UNION ALL SELECT id, 'I', 'no_state' FROM d WHERE domain IS NOT NULL AND state IS NULL AND k % 6 <> 0
UNION ALL SELECT id, 'W', 'ageing' FROM d WHERE state IN ('proposed', 'provisional') AND k % 4 IN (2, 3) UNION ALL SELECT id, 'I', 'no_since' FROM d WHERE state IN ('proposed', 'provisional') AND k % 4 = 0
UNION ALL SELECT id, 'W', 'landed_without_target' FROM o WHERE o % 3 = 0 UNION ALL SELECT id, 'E', 'landed_missing' FROM o WHERE o % 3 <> 0 AND o % 2 <> 0 UNION ALL SELECT DISTINCT id, 'W', 'inversion' FROM o WHERE state = 'normative' AND other IN ('proposed', 'provisional')
""")
def c11_audit_docs(spark, sf_dir):
    c, k = t(spark, sf_dir, "customer"), F.col("c_custkey")
    n = c.count()
    named = lambda k: F.concat(F.when(k % 6 == 0, "adr/").otherwise("d/"), k)
    case = lambda m, values, otherwise=None: reduce(lambda w, kv: w.when(k % m == kv[0], F.lit(kv[1])), list(values.items())[1:], F.when(k % m == next(iter(values)), F.lit(next(iter(values.values()))))).otherwise(F.lit(otherwise))
    docs = c.select(
        named(k).alias("id"), case(7, {0: None, 1: "odd", 2: "edge"}, "core").alias("domain"), case(5, {0: "proposed", 1: "provisional", 2: "weird", 4: "normative"}).alias("state"), case(9, {0: "bad"}, "constitutive").alias("type"), case(10, {0: 7, 1: None}, 3).alias("binding"),
        F.when(k % 8 == 0, F.array(F.lit("add"), F.lit("burn"))).when(k % 8 != 1, F.array(F.lit("add"))).alias("dynamics"), F.to_date(case(4, {0: None, 1: "2023-12-01"}, "2020-01-01")).alias("since"),
    )
    orders = t(spark, sf_dir, "orders")
    refs = orders.select(named(F.col("o_custkey")).alias("src"), named((F.col("o_custkey") * 7 + F.col("o_orderkey")) % n).alias("dst"))
    pointers = orders.join(c.select(k.alias("o_custkey")), "o_custkey", "left_semi").select(named(F.col("o_custkey")).alias("id"), F.when(F.col("o_orderkey") % 3 != 0, "x.md").alias("target"), (F.col("o_orderkey") % 2 == 0).alias("there"))
    setup = C.AuditSetup(("core", "edge"), ("proposed", "provisional", "normative"), ("constitutive", "regulative"), ("add",), registered=("core",), strict=True)
    return C.audit_docs(docs, refs, pointers, F.lit("2024-01-01").cast("date"), setup)


PACKAGES = """
WITH p AS (SELECT p_partkey AS k, p_size AS size, 'p-' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '-kit' ELSE '' END AS folder, p_partkey % 10 AS d FROM part)
"""


@query(PACKAGES + """
SELECT folder, 'E' AS level, 'no_name' AS issue FROM p WHERE k % 11 = 0 UNION ALL SELECT folder, 'E', 'name' FROM p WHERE k % 11 <> 0 AND k % 13 = 0 UNION ALL SELECT folder, 'E', 'name_not_folder' FROM p WHERE k % 11 <> 0 AND (k % 13 = 0 OR k % 17 = 0)
UNION ALL SELECT folder, 'E', 'no_description' FROM p WHERE d = 0 UNION ALL SELECT folder, 'E', 'description_short' FROM p WHERE d = 1 UNION ALL SELECT folder, 'W', 'description_long' FROM p WHERE d = 2
UNION ALL SELECT folder, 'W', 'no_purpose' FROM p WHERE d NOT IN (0, 2, 3) UNION ALL SELECT folder, 'W', 'no_triggers' FROM p WHERE d NOT IN (0, 2) UNION ALL SELECT folder, 'W', 'path_in_description' FROM p WHERE d = 3 UNION ALL SELECT folder, 'W', 'body_too_long' FROM p WHERE size >= 50
UNION ALL SELECT folder, 'W', 'family_file' FROM p WHERE k % 4 = 0 AND k % 12 <> 0 UNION ALL SELECT folder, 'I', 'family_section' FROM p WHERE k % 4 = 0 AND k % 8 <> 0
UNION ALL SELECT DISTINCT folder, 'E', 'dead_link' FROM p JOIN lineitem ON l_partkey = k WHERE l_quantity > 49 UNION ALL SELECT DISTINCT folder, 'E', 'link_outside' FROM p JOIN lineitem ON l_partkey = k WHERE l_discount > 0.09
""")
def c12_package_findings(spark, sf_dir):
    folder = lambda k: F.concat(F.lit("p-"), k, F.when(k % 4 == 0, "-kit").otherwise(""))
    k, d = F.col("p_partkey"), F.col("p_partkey") % 10
    name = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.concat(F.lit("P_"), k)).when(k % 17 == 0, "other-name").otherwise(folder(k))
    said = F.when(d == 0, F.lit(None)).when(d == 1, "short").when(d == 2, F.repeat(F.lit("use it when, "), F.lit(40))).when(d == 3, "look at /home/x for this").otherwise(F.repeat(F.concat("p_name", F.lit(" ")), F.lit(5)))
    part = t(spark, sf_dir, "part")
    packages = part.select(folder(k).alias("folder"), name.alias("name"), said.alias("description"), F.concat(F.when(k % 8 == 0, "# All\n## Compose\n").otherwise(""), F.repeat(F.lit("x\n"), F.col("p_size") * 10 + 3)).alias("body"))
    links = t(spark, sf_dir, "lineitem").select(folder(F.col("l_partkey")).alias("folder"), F.lit("t").alias("target"), (F.col("l_quantity") > 49).alias("dead"), (F.col("l_discount") > 0.09).alias("outside"))
    files = part.filter(k % 12 == 0).select(folder(k).alias("folder"), F.lit("references/sources.md").alias("file"))
    return C.package_findings(packages, links, families=[("-kit", "references/sources.md", "Compose")], files=files)


# extension surface


@query("SELECT 'big' AS check, 'quantity' AS rule, 'o' || l_orderkey AS unit FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT 'broken', 'check-failed', ''")
def f1_checks(spark, sf_dir):
    names = {"big": lambda f: f.filter("extra.dead").select(F.lit("quantity").alias("rule"), F.lit("warn").alias("level"), "unit", F.lit("big").alias("message")), "broken": lambda f: f.select("no_such_column")}
    for name, check in names.items():
        checks.unregister_check(name)
        checks.register_check(name, check, phases=("f1",))
    try:
        return checks.run_checks(_facts(spark, sf_dir), "f1").select("check", "rule", "unit")
    finally:
        for name in names:
            checks.unregister_check(name)


@query(r"SELECT conv_id, turn, len(list_intersect(string_split(lower(text), ' '), ['the', 'der', 'la', 'de'])) AS score FROM conversations WHERE text IS NOT NULL")
def f3_scorer(spark, sf_dir):
    def start():
        def score(query: str, texts: list[str]) -> list[float]:
            wanted = set(query.split(" "))
            return [float(len(wanted & set(x.lower().split(" ")))) for x in texts]

        return score

    pairs = t(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.lit("the der la de").alias("query"), "text")
    return R.score_with(pairs, start).select("conv_id", "turn", F.col("score").cast("long").alias("score"))


# streams, run to the end of what is there


def _payloads(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    k = (F.col("conv_id") + F.col("turn")) % 5
    payload = F.when(k == 0, "").when(k == 1, "{oops").when(k == 2, "[1]").otherwise(F.to_json(F.struct(F.lit("s1").alias("session_id"), F.col("text").alias("prompt"))))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), payload.alias("payload"))


#: A row whose decision fails, for good.
UNDECIDABLE = 3000
ERRORS = f"SELECT conv_id * 1000 + turn AS seq, CASE (conv_id + turn) % 5 WHEN 0 THEN 'empty_stdin' WHEN 1 THEN 'bad_stdin_json' WHEN 2 THEN 'bad_stdin_shape' ELSE CASE WHEN conv_id * 1000 + turn = {UNDECIDABLE} THEN 'decide_failed' END END AS error FROM conversations WHERE text IS NOT NULL"


def _observed(spark, sf_dir) -> tuple[str, str]:
    """Two ledgers of payloads in three batches."""
    out, weak = fresh_dir(spark, "observed"), fresh_dir(spark, "weak")

    def decide(rows):
        decided = D.triage(rows, RULES, None, id_col="seq", text="hint")
        return decided.withColumn("action", F.when((F.col("seq") == UNDECIDABLE) & F.col("error").isNull(), F.raise_error(F.lit("can't be decided")).cast("string")).otherwise(F.col("action")))

    T.observe_stream(_stream(_payloads(spark, sf_dir), "payloads", 6), RULES, out, weak, fresh_dir(spark, "observed-ck"), decide=decide).awaitTermination()
    return out, weak


@query(ERRORS)
def t1_observe_stream(spark, sf_dir):
    return spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(_observed(spark, sf_dir)[0]).select("seq", "error")


@query(scores_sql(f"SELECT conv_id * 1000 + turn AS doc_id, left(trim(text), 4000) AS text FROM conversations WHERE text IS NOT NULL AND (conv_id + turn) % 5 > 2 AND conv_id * 1000 + turn <> {UNDECIDABLE}") + "SELECT doc_id AS seq, domain, action, confidence FROM t WHERE action <> 'dispatch' OR confidence <> 'high'")
def t2_weak_stream(spark, sf_dir):
    return spark.read.parquet(_observed(spark, sf_dir)[1]).select("seq", "domain", "action", "confidence")


def _stream(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df as a stream; with files, in that many, dealt out by a hash of the rows (so out of any order) and read two at a time."""
    spark = df.sparkSession
    if files is None:
        return spark.readStream.schema(df.schema).json(written(df, name))
    dealt = df.repartition(files, F.xxhash64(*df.columns))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).json(written(dealt, name))


def _drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    path = fresh_dir(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", fresh_dir(spark, f"{name}-ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query("SELECT event_id, sha256(event_type) AS hint_hash, CASE WHEN value < 0 THEN 0 ELSE round(value, 3) END AS duration_ms FROM events")
def t3_event_stream(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("hint"), F.col("user_id").cast("string").alias("work_unit_id"), F.col("value").alias("duration_ms"))
    return _drained(T.event_stream(_stream(e, "raw-events")), "redacted").select("event_id", "hint_hash", "duration_ms")


@query("""
WITH k AS (SELECT event_type AS series, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events)
SELECT series, CASE WHEN count(*) = 1 THEN 'baseline' WHEN max(value) FILTER (k = 1) > max(value) FILTER (k > 1) THEN 'new-high' ELSE 'flat' END AS status, max(value) FILTER (k = 1) AS latest, count(*) AS points FROM k WHERE k <= 8 GROUP BY 1
""")
def t4_new_high_stream(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("event_id").alias("ts"), F.lit(0).cast("long").alias("seq"), "value")
    out = _drained(T.new_high_stream(_stream(e, "points", 6), 8), "new-high", "update")
    return out.groupBy("series").agg(F.max_by(F.struct("status", "latest", "points"), "batch").alias("r")).select("series", "r.status", "r.latest", "r.points")


@query(WS_PARTS + "SELECT CAST(user_id AS VARCHAR) AS session, place // 20 AS part_no, place, CAST(epoch_us(ts) AS BIGINT) AS at, event_type AS direction FROM m")
def t8_ws_session_stream(spark, sf_dir):
    """Six files out of any order, read two at a time; then a message long after the others, so that their connections end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    m = t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("direction"), F.col("props").alias("text"))
    path = fresh_dir(spark, "messages")
    m.repartition(6, F.xxhash64(*m.columns)).write.parquet(path)
    m.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("session"), (F.col("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts"), F.lit("").alias("direction"), F.lit("").alias("text")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 2).parquet(path)
    out = _drained(T.ws_session_stream(stream, delay="400 days", quiet_s=3600, most=20), "ws")
    return out.select("session", "part_no", "place", F.unix_micros("ts").alias("at"), "direction")


@query("SELECT lower(event_type) AS k FROM events GROUP BY 1")
def t5_dedupe_stream(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"))
    return _drained(T.dedupe_stream(_stream(e, "hints", 6), "text", delay="20000 days"), "deduped").select(F.lower("text").alias("k"))


@query("SELECT doc_id FROM documents WHERE n_chars % 2 = 0")
def d5_adapt_closed(spark, sf_dir):
    """Rows that the consumer's view closes, as their confidence is none of the known ones."""
    d = _decisions(spark, sf_dir)
    empty = F.array().cast("array<string>")
    rows = d.withColumns({"confidence": F.when(F.col("domain") == "none", "odd").otherwise("low"), "mode": F.lit("plan"), "action": F.lit("ask"), "candidates": empty, "must_not": empty, "recipe": F.lit(""), "members": empty})
    return D.adapt(rows, ["law"]).filter("NOT valid").select("doc_id")
