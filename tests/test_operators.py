"""Operators whose inputs the given tables don't have: small fixtures of our own."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from weir.functions import patterns as P
from weir.functions import text as X
from weir.functions.patterns import flex_variants, glob_regex
from weir.operators import aggregates as A
from weir.operators import checks, contracts as C, decide as D, docclass as DC, extract as E, filters as L, graph as G, joins as J, ranking as R
from weir.sources import io as IO


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def write(tmp_path, name, lines):
    p = tmp_path / name
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(p)


# S1-S4, S6, S8-S11


def test_read_cases_tags_tier_and_skips_blank(spark, tmp_path):
    write(tmp_path, "a-tier.jsonl", [json.dumps({"id": "a1", "query": "x", "expect": {"domain": "d", "skills": ["s"], "band": [0.1, 0.9]}}), ""])
    write(tmp_path, "c-tier.jsonl", [json.dumps({"id": "c1", "query": "y", "expect": {"action": "handoff"}, "tier": "C2"})])
    cases = L.with_expectation(IO.read_cases(spark, str(tmp_path)))
    assert rows(cases, "id", "tier", "oos", F.array_join("wanted", ",")) == [("a1", "A", False, "s"), ("c1", "C2", True, "")]


def test_read_events_counts_malformed_and_missing(spark, tmp_path):
    p = write(tmp_path, "e.jsonl", ['{"event":"a","ok":true,"duration_ms":1.5}', "{broken", "", '{"event":"b"}'])
    good, report = IO.read_events(spark, p)
    assert rows(good, "event", "duration_ms") == [("a", 1.5), ("b", None)]
    assert rows(report) == [(1, False)]
    none, report = IO.read_events(spark, str(tmp_path / "absent.jsonl"))
    assert none.count() == 0 and rows(report) == [(0, True)]


def test_read_facts_is_strict_and_merge_checks_keys(spark, tmp_path):
    line = '{"v":1,"unit":"u","kind":"link","name":"n","file":"f.md","fidelity":"exact","extra":{"to":"g.md"}}'
    facts = IO.read_facts(spark, write(tmp_path, "f.jsonl", [line]))
    assert rows(facts, "unit", "extra.to") == [("u", "g.md")]
    with pytest.raises(Exception):
        IO.read_facts(spark, write(tmp_path, "bad.jsonl", [line, "{oops"])).collect()
    extra = spark.createDataFrame([(1, "u", "decl", "f", "exact")], "v int, unit string, kind string, file string, fidelity string")
    assert IO.merge_facts(facts, extra).count() == 2
    with pytest.raises(Exception, match="lacks"):
        IO.merge_facts(facts, extra.withColumn("v", F.lit(2))).collect()


def test_transcripts(spark, tmp_path):
    lines = [
        {"type": "user", "timestamp": "1", "message": {"content": "please look"}},
        {"type": "assistant", "timestamp": "2", "message": {"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "tool_use", "name": "Skill", "input": {"skill": "s1"}}]}},
        {"type": "user", "timestamp": "3", "message": {"content": "again"}},
        {"type": "assistant", "timestamp": "4", "message": {"content": [{"type": "tool_use", "name": "Skill", "input": {"skill": "s2"}}]}},
    ]
    write(tmp_path, "s.jsonl", [json.dumps(x) for x in lines])
    turns = IO.read_transcripts(spark, str(tmp_path))
    assert rows(turns, "turn", "role", "text", "activated") == [(1, "user", "please look", None), (2, "assistant", "a b", "s1"), (3, "user", "again", None), (4, "assistant", "", "s2")]
    labelled = J.forward_label(turns, 4, "session", "turn", "role", "activated")
    assert rows(labelled, "turn", "actual") == [(1, "s1"), (3, "s2")]


def test_census_facts_ledger_snapshot(spark, tmp_path):
    (tmp_path / "src/deep").mkdir(parents=True)
    (tmp_path / "node_modules/x").mkdir(parents=True)
    (tmp_path / "src/a.PY").write_text("1234")
    (tmp_path / "src/deep/b").write_text("1")
    (tmp_path / "node_modules/x/c.js").write_text("1")
    assert rows(IO.file_census(spark, str(tmp_path)), "path", "ext", "bytes", "kind") == [("src", "", 0, "dir"), ("src/a.PY", ".py", 4, "file"), ("src/deep", "", 0, "dir"), ("src/deep/b", "", 1, "file")]
    facts = spark.createDataFrame([("u", "k", "b", "f2", 1), ("u", "k", "a", "f1", 2), ("u", "k", "c", "f1", 1)], "unit string, kind string, name string, file string, line int")
    out = str(tmp_path / "out")
    IO.write_facts(facts, out, single=True)
    assert [json.loads(r["value"])["name"] for r in spark.read.text(out).collect()] == ["c", "a", "b"]
    events = spark.createDataFrame([("2024-01-01T05:00:00Z", "a"), ("2024-01-02T05:00:00Z", "b")], "timestamp string, event string")
    ledger = str(tmp_path / "ledger")
    assert IO.read_ledger(spark, ledger).count() == 0
    assert [IO.append_events(events, ledger, n) for n in ("b1", "b1", "b2")] == [True, False, True]
    events.limit(1).withColumn("day", F.to_date("timestamp")).write.partitionBy("day").json(f"{ledger}/attempt={'0' * 32}")  # an attempt that was lost
    assert rows(IO.read_ledger(spark, ledger), "event", "batch") == [("a", "b1"), ("a", "b2"), ("b", "b1"), ("b", "b2")]
    with pytest.raises(ValueError):
        IO.append_events(events, ledger, "../b")
    assert rows(IO.snapshot(spark.createDataFrame([("a", True), ("a", True)], "id string, pass boolean"), "id", "pass")) == [("a", True)]


LOCK = {
    "source": "l1", "lockfileVersion": 3,
    "packages": {
        "": {"version": "0"}, "node_modules/a": {"version": "1", "dependencies": {"dep": "^1", "gone": "1"}}, "node_modules/a/node_modules/dep": {"version": "1", "integrity": "sha512-x"},
        "node_modules/dep": {"version": "2"}, "node_modules/b": {"version": "1", "dependencies": {"dep": "^2"}}, "node_modules/d": {"version": "9", "dev": True}, "node_modules/@s/e": {"version": "3", "optional": True},
    },
}


def test_lockfile_nested_resolution(spark, tmp_path):
    df = spark.read.schema(IO.LOCKFILE).json(write(tmp_path, "l.jsonl", [json.dumps(LOCK)]))
    packages = IO.lockfile_packages(df)
    assert {r["ref"] for r in packages.collect()} == {"a@1", "dep@1", "dep@2", "b@1"}
    deps = packages.select("source", "path", F.explode("dependencies").alias("dep"))
    found = J.resolve_nested(packages, deps)
    assert rows(found, "path", "dep", "dep_path") == [("node_modules/a", "dep", "node_modules/a/node_modules/dep"), ("node_modules/b", "dep", "node_modules/dep")]
    assert rows(G.dependency_edges(found, packages), "ref", F.array_join("depends_on", ",")) == [("a@1", "dep@1"), ("b@1", "dep@2")]
    with pytest.raises(Exception, match="not supported"):
        IO.lockfile_packages(df.withColumn("lockfileVersion", F.lit(1))).collect()


def test_redact(spark):
    df = spark.createDataFrame([("secret", "ok-1", "-2", "3", "/home/x"), ("", "has space", "1.23456", "x", "docs/a")], "hint string, work_unit_id string, duration_ms string, n string, p string")
    out = IO.redact_event(df, path="p", counts=["n"]).orderBy("p").collect()
    assert "hint" not in out[0].asDict()
    assert out[0]["work_unit_id"].startswith("opaque-") and len(out[0]["work_unit_id"]) == 39 and out[0]["duration_ms"] == 1.235 and out[0]["n"] == 0 and out[0]["p"] == "docs/a"
    assert out[1]["work_unit_id"] == "ok-1" and out[1]["duration_ms"] == 0 and out[1]["n"] == 3 and out[1]["p"] == "redacted"


# text functions with scripts that the given tables lack


def test_tokens_cjk(spark):
    df = spark.createDataFrame([(1, "Run PyTest 数据库迁移 库 the"), (2, None), (3, "")], "id int, t string")
    assert rows(df.select("id", F.array_join(X.lex_tokens(F.col("t")), " "))) == [(1, "run pytest 数据 据库 库迁 迁移 库"), (2, ""), (3, "")]


def test_lang_emoji_mojibake_cookies(spark):
    df = spark.createDataFrame([("数据库迁移 ok",), ("please 数 look at this text",), ("plain # 1*",), ("smile 😀 now",), ("1️⃣",), ("鍗鈫",)], "t string")
    got = [tuple(r) for r in df.select(X.lang_tag(F.col("t")), X.has_emoji(F.col("t")), X.has_mojibake(F.col("t"))).collect()]
    assert got == [("zh", False, False), ("mixed", False, False), ("en", False, False), ("en", True, False), ("en", True, False), ("zh", False, True)]
    c = spark.createDataFrame([("a=1; b = x=y ;c; a=2;;",)], "t string").select(X.cookie_map(F.col("t")).alias("m")).first()["m"]
    assert c == {"a": "2", "b": "x=y", "c": ""}


def test_modes_and_clauses(spark):
    df = spark.createDataFrame([("请审阅这个",), ("do not modify anything",), ("make a plan",), ("explain it",), ("fix it, without the linter. use tests",)], "t string")
    assert [r[0] for r in df.select(X.mode_of(F.col("t"))).collect()] == ["review", "review", "plan", "explain", "implement"]
    assert df.select(X.active_text(F.col("t"))).collect()[4][0] == "fix it"


def test_flex_and_globs():
    assert flex_variants("policy") == ["policy", "policys", "policies"] and "box" in flex_variants("boxes") and flex_variants("类") == ["类"] and "clas" not in flex_variants("class")
    import re

    for pattern, yes, no in (("**/a.md", ["a.md", "x/y/a.md"], ["xa.md"]), ("src/*.py", ["src/a.py"], ["src/b/a.py"]), ("a?c/**", ["abc/x/y"], ["abc"])):
        assert all(re.match(glob_regex(pattern), p) for p in yes) and not any(re.match(glob_regex(pattern), p) for p in no)


# X10, X11, X13, X20, X25, X32


DOC = "---\nowner: ann # note\nstatus: live\n---\n# T\n\n> Depends: a.md, \n> b.md#x\n> 状态：草案\n\n## Contents\n\n1. [One](#one)\n2. [Two & more](#two--more)\n\n## One\n```\n## not\n[x](y.md)\n```\n### Deep\n## Two & more\nsee [it](../g.md), [ref][r], [r] and `[c](d.md)` https://x.y/z.\n[r]: h.md\n"


def test_toc_headers_links(spark):
    df = spark.createDataFrame([(1, DOC)], "doc_id int, text string")
    lines = E.lines_of(df, "doc_id", "text")
    items = E.toc_items(lines, depth=2).first()["items"]
    assert items == ["1. [One](#one)", "3. [Two & more](#two-more)"]
    assert rows(E.toc_findings(lines, depth=2)) == [(1, "drift")]
    fixed = df.withColumn("text", F.replace("text", F.lit("2. [Two & more](#two--more)"), F.lit("3. [Two & more](#two-more)")))
    assert rows(E.toc_findings(E.lines_of(fixed, "doc_id", "text"), depth=2)) == []
    head = E.doc_headers(df, "doc_id", "text").first()
    assert head["frontmatter"] == {"owner": "ann", "status": "live"} and head["blockquote"] == {"Depends": "a.md, b.md#x", "状态": "草案"} and head["relations"] == ["a.md", "b.md#x"]
    assert rows(E.extract_links(lines), "target", "style") == [("../g.md", "inline"), ("h.md", "reference"), ("h.md", "shortcut")]
    files = spark.createDataFrame([("g.md",), ("docs/h.md",)], "path string")
    links = E.extract_links(lines).withColumn("src", F.lit("docs/d.md"))
    assert rows(J.resolve_links(links, files).select("target", "resolved", "dead").distinct()) == [("../g.md", "g.md", False), ("h.md", "docs/h.md", False)]


def test_headers_hold_the_fields_that_were_put_in(spark):
    rng = random.Random(8)
    value = lambda: rng.choice(["", "x", "a b", "see a.md", "p/q.md#s-1 and r.md", "名 字.md", "v: w", "#no"])
    docs, want = [], []
    for i in range(200):
        front, quoted = ([(f"{rng.choice('abcd')}{rng.choice(['', ' key', '键'])}", value()) for _ in range(rng.randint(0, 5))] for _ in range(2))
        closed = rng.random() < 0.8
        lines = []
        if rng.random() < 0.7:
            lines += ["---"]
            for k, v in front:
                lines += [f"{k}{rng.choice([':', ' : ', ': '])}{v}{rng.choice(['', '  # note: x']) if v else ''}", *rng.sample(["  indented: 1", "1st: no", "no colon", "", "- item"], rng.randint(0, 2))]
            lines += ["---"] if closed else []
        else:
            front = []
        if not closed:
            front = []
        lines += rng.sample(["text", "", "```", "# h"], rng.randint(0, 1)) if closed else []
        fenced = lines and lines[-1] == "```"
        lines += ["> fenced: no", "```"] if fenced else []
        lines += [f"> {k}{rng.choice([':', '：'])} {v}" for k, v in quoted]
        if quoted and rng.random() < 0.5:
            lines[-1] += ","
            lines.append(">  (more)" if rng.random() < 0.5 else "> （more）")
            quoted[-1] = (quoted[-1][0], f"{quoted[-1][1]}, {lines[-1][1:].strip()}".replace(" ,", ",").lstrip() if quoted[-1][1] else f", {lines[-1][1:].strip()}")
        lines += ["", "> second: block"] if quoted else []
        docs.append((i, rng.choice(["\n", "\r\n"]).join(lines)))
        first = lambda fields: dict(reversed(fields))
        want.append((i, first(front), first(quoted), [m for _, v in [*front, *quoted] for m in re.findall(r"[\w.:/-]+\.md(?:#[\w-]+)?", v)]))
    got = E.doc_headers(spark.createDataFrame(docs, "id int, t string"), "id", "t").orderBy("id").collect()
    for r, (i, front, quoted, names) in zip(got, want, strict=True):
        assert (r["frontmatter"], r["blockquote"], r["relations"]) == (front, quoted, names), docs[i]


def test_headers_at_the_edges(spark):
    texts = ["> " + "长" * 12 + "：a", "> " + "长" * 13 + "：a", "> long name of many words: a", "---\na: 1", "---\n---\n> b: 2", None, "", "x\n    > deep: 1\n   > a: 1\ny", "~~~\n> a: 1\n~~~\n> b：c # d", "---\na: 1\na: 2\n ---\nb: 3\n---"]
    got = E.doc_headers(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").orderBy("id").collect()
    assert [(r["frontmatter"], r["blockquote"]) for r in got] == [({}, {"长" * 12: "a"}), ({}, {}), ({}, {"long name of many words": "a"}), ({}, {}), ({}, {"b": "2"}), ({}, {}), ({}, {}), ({}, {"a": "1"}), ({}, {"b": "c"}), ({"a": "1"}, {})]


def test_reviews_code_packets(spark):
    df = spark.createDataFrame([(1, "> review-after: 2024-01-05"), (2, "reviewAfter: 2030-01-01"), (3, "review-after: 2024-13-45")], "id int, text string")
    assert [(r["id"], r["due"]) for r in E.due_reviews(df, F.lit("2024-02-01").cast("date"), "id", "text").orderBy("id").collect()] == [(1, True), (2, False)]
    js = "// import 'no'\nimport x from './a.js'\nconst {y} = require('b')\nexport function go() {}\nclass K {}\n/* function no() {} */\n"
    assert rows(E.code_facts(spark.createDataFrame([(1, js)], "id int, t string"), "id", "t", "js"), "line_no", "kind", "name") == [(2, "import", "./a.js"), (3, "import", "b"), (4, "decl", "go"), (5, "decl", "K")]
    py = '"""import no"""\nfrom a.b import c\nasync def f():\n    pass\n'
    assert rows(E.code_facts(spark.createDataFrame([(1, py)], "id int, t string"), "id", "t", "python"), "line_no", "kind", "name") == [(2, "import", "a.b"), (3, "decl", "f")]
    imports = spark.createDataFrame([("src/m.js", "./a.js?x"), ("src/m.js", "../lib"), ("src/m.js", "./nope"), ("src/m.js", "react")], "src string, spec string")
    files = spark.createDataFrame([("src/a.ts",), ("lib/index.js",)], "path string")
    assert rows(J.resolve_specs(imports, files), "spec", "resolved", "dead", "external") == [("../lib", "lib/index.js", False, False), ("./a.js?x", "src/a.ts", False, False), ("./nope", None, True, False), ("react", None, False, True)]
    packets = spark.createDataFrame([(1, "u", "get", None, None, [("A", "1", None), ("a", None, ("2",))]), (2, "u", "get", 200, "net", None)], "id int, url string, method string, status int, error string, headers array<struct<name:string,value:string,object:struct<value:string>>>")
    got = A.normalize_packets(packets).orderBy("id").collect()
    assert got[0]["headers"] == {"a": "2"} and got[0]["status"] == 0 and got[0]["kind"] == "response" and got[1]["kind"] == "fetch_error" and got[1]["headers"] == {}


def test_indicators_keep_evidence_and_defanged_forms(spark):
    df = spark.createDataFrame([(1, "x\nfound hxxp://evil[.]example/a now"), (2, "see hxxp://evil[.]example/a")], "doc_id int, text string")
    got = {r["indicator"]: r for r in E.extract_indicators(df, "doc_id", "text").filter("kind = 'url'").collect()}
    assert set(got) == {"hxxp://evil[.]example/a", "http://evil.example/a"}
    r = got["http://evil.example/a"]
    assert (r["confidence"], r["docs"], r["doc"], r["line_no"], r["evidence"]) == ("candidate", 2, 1, 2, "found hxxp://evil[.]example/a now")


def test_html_attributes(spark):
    df = spark.createDataFrame([(1, '<p>a<a href="/x" class=k>T <b>b</b></a></p><br><a>no</a>')], "id int, h string")
    assert [(r["attrs"], r["text"], r["inner"]) for r in E.html_elements(df, "id", "h", "a", attr="href").collect()] == [({"href": "/x", "class": "k"}, "T b", "T <b>b</b>")]


def test_html_locators(spark):
    page = "<html><body><div id=a class='x y'><p>one <b>two</b></p><p title=t>three</div><ul><li><a href='/k'>k</a><li><a href='http://z'>z</a></ul><br/></body></html>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, h string")
    found = lambda locator: [(r["tag"], r["text"]) for r in E.html_elements(df, "id", "h", locator).orderBy("ord").collect()]
    assert found("#a > p") == [("p", "one two"), ("p", "three")] and found("div.x.y b") == [("b", "two")] and found("body > p") == []
    assert found("a[href^='/'], b") == [("b", "two"), ("a", "k")] and found("a[href$=z]") == [("a", "z")] and found("p[title]") == [("p", "three")]
    assert found("xpath://div/p[2]") == [("p", "three")] and found("//a[contains(@href, '://')]") == [("a", "z")] and found("/html/body/ul//a[text()='k']") == [("a", "k")] and found("/body") == []
    assert [t for t, _ in found("text:two")] == ["html", "body", "div", "p", "b"]
    r = E.html_elements(df, "id", "h", "css:#a p").orderBy("ord").first()
    assert (r["inner"], r["outer"]) == ("one <b>two</b>", "<p>one <b>two</b></p>")
    for bad in ("a + b", "//a[position()<2]", "a[="):
        with pytest.raises(ValueError):
            E.html_elements(df, "id", "h", bad)


def test_scripts_by_source(spark):
    df = spark.createDataFrame([(1, "http://p/x", "<script>find me\nno</script><script src='/a.js'></script><script src='/a.js'></script><script async src=/b.js></script><script src=/c.js></script>")], "id int, url string, html string")
    external = spark.createDataFrame([("/a.js", 200, "x\n  Find it"), ("/b.js", 404, None)], "src string, status int, source string")
    found, skipped = E.search_sources(df, "find", "id", "url", "html", external=external)
    assert rows(found, "src", "line_no", "preview") == [("/a.js", 2, "Find it"), (None, 1, "find me")]
    assert rows(skipped, "src", "reason") == [("/b.js", "http_404"), ("/c.js", "not_loaded")]
    found, skipped = E.search_sources(df, "find", "id", "url", "html", case=True, most=5)
    assert found.count() == 0 and rows(skipped, "src", "reason") == [("/a.js", "not_loaded"), ("/b.js", "not_loaded"), ("/c.js", "not_loaded"), (None, "over 5 characters")]


def test_fences_within_the_row_equal_the_window(spark):
    texts = ["a\n```\nb\n\n```\nc", "```\nopen\n", "~~~\n```", "  ``` x\n\ny\n\t~~~ \nz\r\n", "", None, "no\nfence\n", "```", "x\n```", "a\n~~~\n~~~\n```\nq\n```\n\nend"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    within = R.mask_fences(E.lines_of(df, "id", "t", fences=True), "id")
    assert rows(within, "id", "line_no", "line") == rows(R.mask_fences(E.lines_of(df, "id", "t"), "id"), "id", "line_no", "line")
    assert E.lines_of(df, "id", "t", fences=True).count() == E.lines_of(df, "id", "t").count()


def test_identifiers_of_sections_and_files(spark):
    text = "## A. First\n1. one\n2. two\n## Other\n3. not\n## B. Second\n7. seven"
    lines = E.lines_of(spark.createDataFrame([(1, text)], "doc_id int, t string"), "doc_id", "t", fences=True)
    assert rows(E.id_defs(lines, "none", ["section_list"]), "line_no", "id") == [(2, "A1"), (3, "A2"), (7, "B7")]
    files = spark.createDataFrame([("x/ADR-12-name.md",), ("x/readme.md",)], "path string")
    assert rows(E.id_files(files, "[A-Z]+-[0-9]+"), "path", "id", "mode") == [("x/ADR-12-name.md", "ADR-12", "filename")]


def test_rows_of_an_index_without_a_marker(spark):
    text = "| Name | What |\n|---|---|\n| `one` | x |\n| one / two (old) | y |\n| three | removed |\n| four / one | z |\n| 五 | k |\ntext | nine |"
    lines = E.lines_of(spark.createDataFrame([(1, text)], "doc_id int, t string"), "doc_id", "t")
    names = spark.createDataFrame([("One",), ("two",)], "name string")
    assert rows(C.free_rows(lines, names, "removed"), "line_no", "cell") == [(6, "four / one")]


def test_package_families(spark):
    said = "use when, for this, and that"
    packages = spark.createDataFrame([("a-kit", "a-kit", said, "# A\n## Compose\n"), ("b-kit", "b-kit", said, "no title"), ("ccc", "ccc", said, "")], "folder string, name string, description string, body string")
    links = spark.createDataFrame([], "folder string, target string, dead boolean, outside boolean")
    files = spark.createDataFrame([("a-kit", "ref/sources.md")], "folder string, file string")
    out = C.package_findings(packages, links, families=[("-kit", "ref/sources.md", "Compose")], files=files)
    assert rows(out, "folder", "level", "issue") == [("b-kit", "I", "family_section"), ("b-kit", "W", "family_file")]


def test_ranks_of_groups_with_ties_and_nulls(spark):
    data = [("a", 5.0)] * 9 + [("a", 1.0), ("a", None), ("b", 3.0), (None, 2.0), (None, 4.0), ("c", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    got = {r["k"]: (r["p0"], r["p5"], r["p95"]) for r in R.at_ranks(df, "v", ["k"], {"p0": R.nearest_rank(0.0), "p5": R.nearest_rank(0.5), "p95": R.nearest_rank(0.95)}).collect()}
    want = {}
    for k in {k for k, _ in data}:
        if vs := sorted(v for j, v in data if j == k and v is not None):
            want[k] = tuple(vs[min(len(vs) - 1, int(len(vs) * f))] for f in (0.0, 0.5, 0.95))
    assert got == want and R.rank_percentile(df.limit(0), "v", 0.5).count() == 0


def test_forms_of_terms(spark):
    for term, form in (("box", "boxes"), ("policy", "policies"), ("policies", "policy"), ("matches", "match"), ("tests", "test"), ("api key", "api keys")):
        assert form in flex_variants(term)
    for term in ("a", "ies", "bus", "类", "C++", "x-", "boss", "radii", "status"):
        assert flex_variants(term)[0] == term and all(v.startswith(term[:-3] or term[:1]) for v in flex_variants(term))
    texts = ["a box, boxes", "my-box", "the api keys", "类型", "c++ x", "review it", "box_", "", "reviews"]
    terms = ["box", "api key", "类", "c++", "review", "a", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("r", P.runs_of(F.col("t"), terms))
    for r in df.select("t", *(P.holds(F.col("t"), F.col("r"), x).alias(f"h{i}") for i, x in enumerate(terms)), *(P.matches(F.col("t"), x).alias(f"m{i}") for i, x in enumerate(terms))).collect():
        assert [r[f"h{i}"] for i in range(len(terms))] == [r[f"m{i}"] for i in range(len(terms))], r["t"]


def test_regex_gate_reports_a_bad_pattern(spark):
    df = spark.createDataFrame([("a.md", "x1\nx2")], "file string, text string")
    out = E.regex_gate(df, [{"id": "g", "pattern": "x."}, {"id": "bad", "pattern": "("}], "file", "text")
    assert rows(out, "gate", "line") == [("bad", 0), ("g", 1), ("g", 2)]
    assert E.regex_gate(df, [{"id": "bad", "pattern": "("}], "file", "text").count() == 1


def test_regex_gate_over_whole_texts(spark):
    texts = ["one\ntwo\n\nthree two", "", None, "xx\nx", "\n\n\nend", "a\uffffb", "é\r\nx", "x" * 120, "two\r\nthree"]
    df = spark.createDataFrame([(f"f{i}.md", t) for i, t in enumerate(texts)], "file string, text string").withColumns({c: F.lit("mine") for c in ("gate", "line", "match", "total", "hits")})
    gates = [{"id": "over", "pattern": r"two\s+three|one\ntwo"}, {"id": "empty", "pattern": "x*"}, {"id": "start", "pattern": "^"}, {"id": "first", "pattern": "x", "once": True}, {"id": "end", "pattern": "end$"}, {"id": "mark", "pattern": "[^a-z]"}]
    got = E.regex_gate(df, gates, "file", "text")
    want = []
    for g in gates:
        for i, t in enumerate(texts):
            found = list(re.finditer("(?m)" + g["pattern"], (t or "").replace("\uffff", "\ufffe")))
            found = found if t or g["id"] != "start" else []  # to Java, an empty text has no start of a line
            listed = found[: 1 if g.get("once") else 50]
            want += [(g["id"], f"f{i}.md", (t or "").count("\n", 0, m.start()) + 1, m[0][:200], None) for m in listed]
            want += [(g["id"], f"f{i}.md", 0, None, len(found))] if len(found) > 50 and not g.get("once") else []
    assert rows(got.select("gate", "file", "line", "match", "total")) == sorted(want, key=repr)


def test_local_definitions_stay_in_their_document(spark):
    docs = spark.createDataFrame([("a", "# ID-1\n**L-1** x\nuse L-1, ID-1, ID-2, L-2\n```\nL-9\n```"), ("b", "L-1 and ID-1\n**L-2**: y\nL-2 L-2 ID-9"), ("c", None)], "doc_id string, t string")
    lines = E.lines_of(docs, "doc_id", "t", fences=True)
    everywhere = E.id_defs(lines, "ID-[0-9]", ["heading"]).unionByName(spark.createDataFrame([("z", 1, "L-2", "table")], "doc_id string, line_no int, id string, mode string"))
    got = E.id_refs(lines, ["ID-[0-9]", "L-[0-9]"], everywhere, local=E.id_defs(lines, "L-[0-9]", ["bold"]))
    assert rows(got, "doc_id", "line_no", "id", "scope") == sorted([("a", 3, "L-1", "local"), ("a", 3, "ID-1", "global"), ("a", 3, "ID-2", None), ("a", 3, "L-2", "global"), ("b", 1, "L-1", None), ("b", 1, "ID-1", "global"), ("b", 3, "L-2", "local"), ("b", 3, "ID-9", None)], key=repr)
    assert got.filter("defined <> (scope IS NOT NULL)").count() == 0


def test_headings_of_front_matter_dont_count(spark):
    texts = [("a", "---\n## no\n---\n## yes\n---\n## too"), ("b", "\n---\n## yes\n---"), ("c", "---\n## open"), ("d", " --- \r\n## no\r\n---\r\n## yes\r"), ("e", "--- x\n## yes"), ("f", None), ("g", "---\n---\n## yes")]
    df = spark.createDataFrame(texts, "doc_id string, t string")
    want = [("a", 4, "yes"), ("a", 6, "too"), ("b", 3, "yes"), ("d", 4, "yes"), ("e", 2, "yes"), ("g", 3, "yes")]
    for fences in (True, False):
        assert rows(E.headings(E.lines_of(df, "doc_id", "t", fences=fences)), "doc_id", "line_no", "heading") == want


# decisions


RULES = D.RuleSet(
    domains=(D.Domain("test", triggers=("pytest",), weak=("cli",), members=("tester",), default_recipe="t"), D.Domain("eng", triggers=("git hook",), quality=("quality gate",), members=("linter", "gone"), default_recipe="e")),
    ready=frozenset({"tester", "linter"}),
    recipes={"t": ("tester",), "e": ("linter",)},
)
HINTS = [("1", "run the pytests"), ("2", "a cli banner"), ("3", "fix the git hooks with a quality gate"), ("4", "nothing at all"), ("5", ""), ("6", "use gone now"), ("7", "pytest, do not use tester"), ("8", "lint formatting rules")]


def test_triage(spark):
    df = spark.createDataFrame(HINTS, "id string, text string")
    docs = spark.createDataFrame([("linter", "checks formatting", ["lint", "format rules"]), ("tester", "runs", ["pytest"])], "name string, description string, triggers array<string>")
    got = {r["id"]: r for r in D.triage(df, RULES, docs).collect()}
    assert (got["1"]["domain"], got["1"]["confidence"], got["1"]["action"], got["1"]["candidates"]) == ("test", "medium", "dispatch", ["tester"])
    assert (got["2"]["confidence"], got["2"]["action"]) == ("low", "ask") and got["2"]["reasons"] == ["weak_trigger_only: cli"]
    assert (got["3"]["domain"], got["3"]["confidence"]) == ("eng", "high")
    assert (got["4"]["action"], got["4"]["reasons"]) == ("handoff", ["no_domain_triggers_matched"])
    assert got["5"]["reasons"] == ["empty_hint"]
    assert (got["6"]["action"], got["6"]["reasons"]) == ("ask", ["skill_unavailable: gone"])
    assert got["7"]["candidates"] == [] and got["7"]["action"] == "dispatch"
    assert got["8"]["action"] == "ask" and got["8"]["candidates"] == ["linter"] and got["8"]["reasons"][0].startswith("lexical_fallback: linter@1.00")
    assert rows(L.suspicious(D.triage(df, RULES, docs)), "id") == [("4",), ("5",), ("8",)]
    assert rows(L.weak_decisions(D.triage(df, RULES, docs)), "id") == [(x,) for x in "1245678"]
    recipes = spark.createDataFrame([("test", "t", None, "tester", 1), ("eng", "e", None, "gone", 1)], "domain string, recipe string, flag string, member string, ord int")
    made = {r["id"]: r for r in D.adapt(D.assemble_recipe(D.triage(df, RULES, docs), recipes, {}, RULES), ["test", "eng"]).collect()}
    assert made["1"]["load"] == ["tester"] and made["1"]["prompt_action"] == "implement" and made["1"]["valid"]
    assert made["3"]["action"] == "ask" and "recipe_unavailable: gone" in made["3"]["reasons"] and made["3"]["prompt_action"] == "ask_clarification"
    broken = D.adapt(D.assemble_recipe(D.triage(df, RULES, docs), recipes, {}, RULES).withColumn("confidence", F.lit("odd")), ["test", "eng"])
    assert {(r["valid"], r["prompt_action"]) for r in broken.collect()} == {(False, "handoff")}
    with pytest.raises(ValueError):
        D.RuleSet(domains=(D.Domain("a"), D.Domain("a")))


def test_sets_are_listed_within_a_bound(spark):
    df = spark.createDataFrame([("a", i % 7, None) for i in range(40)] + [("b", None, "x"), (None, 1, "y"), (None, 1, "x")], "k string, s int, d string")
    assert rows(A.merge_components(df, "k", "s", "d", most=3), "k", "sources", "n_sources", "depends_on", "n_depends_on") == sorted([("a", [0, 1, 2], 7, [], 0), ("b", [], 0, ["x"], 1), (None, [1], 1, ["x", "y"], 2)], key=repr)
    refs = spark.createDataFrame([("a",), ("a",), ("z",)], "k string")
    assert rows(A.label_index(df, refs, "k", "s", most=2), "k", "sites", "n_sites", "refs", "dead") == sorted([("a", [0, 1], 7, 2, False), ("b", [], 0, 0, True), (None, [1], 1, 0, True)], key=repr)


def test_vectors_with_ids_of_any_type(spark, monkeypatch):
    from weir.operators import vectors

    monkeypatch.setattr(vectors, "CELL", 40), monkeypatch.setattr(vectors, "BLOCK", 7), monkeypatch.setattr(vectors, "AT_ONCE", 3)
    rng = random.Random(1)
    data = [(f"v{i:03}", rng.choice("abc"), [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(150)]
    df = spark.createDataFrame([*data, (None, "a", [1.0] * 4), ("n1", None, [9.0] * 4), ("n2", "a", None)], "id string, label string, v array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    asked = df.filter("id LIKE '%5' OR id = 'n2'")
    got = R.score_pairs(asked, df.filter("label IS NOT NULL"), "id", "v", "id", "v", 3)
    want = [(q, d, s, k + 1) for q, _, v in data if q.endswith("5") for k, (s, d) in enumerate(sorted(((dot(v, w), d) for d, _, w in data), key=lambda x: (-x[0], x[1]))[:3])]
    assert rows(got, "qid", "doc", "score", "rank") == sorted(want, key=repr)
    best = [(q, x, max(dot(v, w) for d, y, w in data if y == x and d != q)) for q, _, v in data if q.endswith("5") for x in "abc"]
    assert rows(R.best_by(asked, df, "id", "v", "label"), "qid", "item", "score") == sorted(best, key=repr)
    assert R.score_pairs(asked.limit(0), df, "id", "v", "id", "v", 3).count() == 0 and R.best_by(asked, df.limit(0), "id", "v", "label").count() == 0


def test_grid_of_vectors_dealt_over_many_tasks(spark):
    vs = [(i, [float((i * k) % 97) for k in range(1, 6)]) for i in range(3000)]
    df = spark.createDataFrame(vs, "id long, v array<float>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # large tables aren't coalesced to one task
    try:
        got = R.score_pairs(df.filter("id % 300 = 0"), df, "id", "v", "id", "v", 2).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for q, a in vs[::300]:
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), d) for d, b in vs)[:2]
        want += [(q, d, -s, k) for k, (s, d) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_annotate_and_normalize(spark):
    facts = spark.createDataFrame([("f", 1, "exact"), ("f", 2, "regex-degraded"), ("g", None, "syntactic")], "file string, line int, fidelity string")
    findings = spark.createDataFrame([("f", 1), ("f", 9), ("g", 3), ("h", 1)], "file string, line int")
    assert rows(J.annotate_fidelity(findings, facts), "file", "line", "fidelity") == [("f", 1, "exact"), ("f", 9, "regex-degraded"), ("g", 3, "syntactic"), ("h", 1, None)]
    reports = spark.createDataFrame([("s", {"lib": ("high", True, "<2", ["b", "", "a", "b"]), "odd": ("weird", None, None, None)})], "source string, vulnerabilities map<string,struct<severity:string,isDirect:boolean,range:string,via:array<string>>>")
    assert rows(A.normalize_findings(reports), "name", "severity", "is_direct", F.array_join("via", ",")) == [("lib", "high", True, "a,b"), ("odd", "info", False, "")]
    specs = spark.createDataFrame([("f", 1, None, 0), ("x", 1, 2, None)], "file string, min_imports int, min_decls int, max_malformed int")
    own = spark.createDataFrame([("f", "import", "ok.name"), ("f", "decl", "bad name")], "file string, kind string, name string")
    assert rows(A.fixture_asserts(own, specs), "file", "check", "ok") == [("f", "max_malformed", False), ("f", "min_imports", True), ("x", "min_decls", False), ("x", "min_imports", False)]
    assert A.scan_state(own.limit(0), 3, 1) == ("partial", "none")
    assert A.is_fresh_artifact(own, own.orderBy("name")) and not A.is_fresh_artifact(own, own.limit(1))


# contracts


SPEC = [
    {
        "class": "adr", "match": {"path": ["adr/**"], "name": "*.md"}, "header": "warn", "required": ["id", "status"], "freshness": {"anyOf": ["date", "updated"]}, "states": {"field": "status", "vocab": ["proposed", "accepted"], "tolerate": ["old"]},
        "fields": {"id": {"equalsFilenameStem": True}, "kind": {"vocab": ["x"], "tolerate": ["y"]}},
        "conditional": [
            {"when": {"status": "accepted"}, "require": "by", "msg": "{when.status} needs {field}"}, {"when": {"status": {"notIn": ["accepted"]}}, "check": {"review": {"lt-date": "today"}}, "level": "warn"},
            {"when": {"kind": "x", "status": {"notIn": ["proposed"]}}, "require": ["a", "b"]},
        ],
    },
    {"class": "note", "match": {"any": [{"path": ["n/**"], "notPath": ["n/skip/**"]}, {"exactPath": ["top.md"]}, {"any": [{"name": "deep*"}]}]}},
]


def test_docclass(spark):
    docs = spark.createDataFrame(
        [
            ("adr/a1.md", {"id": "a1", "status": "accepted", "date": "", "by": ""}), ("adr/a2.md", {"id": "zz", "status": "odd", "updated": "2024-01-01", "review": "2020-01-01"}), ("adr/a3.md", {"id": "a3", "status": "proposed", "review": "2020-01-01"}),
            ("adr/a4.md", None), ("adr/a5.md", {"id": "a5", "status": "old", "date": "x", "kind": "x", "b": "1", "review": "soon"}), ("adr/a6.md", {}), ("adr/a7.md", {"id": "", "status": "", "date": "x", "kind": "z"}), ("n/x.md", None), ("adr/a.txt", None),
        ],
        "rel string, fields map<string,string>",
    )
    got = DC.docclass_findings(docs, SPEC, F.lit("2024-06-01").cast("date"))
    assert rows(got, "rel", "rule", "level", "field") == [
        ("adr/a1.md", "conditional", "error", "by"), ("adr/a2.md", "states", "error", "status"), ("adr/a2.md", "stem", "error", "id"), ("adr/a3.md", "conditional-check", "warn", "review"), ("adr/a3.md", "freshness", "error", ""),
        ("adr/a4.md", "freshness", "error", ""), ("adr/a4.md", "header", "warn", ""), ("adr/a4.md", "required", "error", "id"), ("adr/a4.md", "required", "error", "status"), ("adr/a5.md", "conditional", "error", "a"),
        ("adr/a6.md", "freshness", "error", ""), ("adr/a6.md", "required", "error", "id"), ("adr/a6.md", "required", "error", "status"),
        ("adr/a7.md", "required", "error", "id"), ("adr/a7.md", "required", "error", "status"), ("adr/a7.md", "states", "error", "status"), ("adr/a7.md", "stem", "error", "id"), ("adr/a7.md", "vocab", "error", "kind"),
    ]
    assert got.filter("rule = 'conditional' AND field = 'by'").first()["message"] == "accepted needs by"
    wrong = [{"class": "x", "pth": []}, {"class": "x", "match": {"notPath": ["a"]}}, {"class": "x", "match": {"path": "a", "any": [{"nme": "b"}]}}, {"class": "x", "match": {"path": "a"}, "conditional": [{"when": {"a": {"in": ["b"]}}}]}, {"class": "x", "match": {"path": "a"}, "fields": {"a": {"vcab": []}}}]
    for spec in wrong:
        with pytest.raises(ValueError):
            DC.docclass_findings(docs, [spec], F.current_date())


def test_match_trees(spark):
    paths = ["n/a.md", "n/skip/a.md", "top.md", "q/deep1", "adr/x.md", "adr/x.txt", "other", "a/b.md", "a/b.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "rel string")
    assert rows(DC.classify_docs(df, SPEC).filter("class IS NOT NULL"), "rel", "class") == [("adr/x.md", "adr"), ("n/a.md", "note"), ("q/deep1", "note"), ("top.md", "note")]
    both = [{"class": "both", "match": {"path": ["a/**", "**/*.md"]}}]
    assert rows(DC.classify_docs(df, both).filter("class IS NOT NULL"), "rel") == [("a/b.md",)]


def test_sources_audit_packages(spark):
    today = F.lit("2024-06-01").cast("date")
    sources = spark.createDataFrame([("a", "https://x.y/o/r", "a" * 40, "f1", 30, "2024-01-01"), ("b", "http://x.y/o/r", "main", "f2", None, None), ("c", "https://u@x.y/o/r", "2024-01-01", "f1", 365, "2024-05-01")], "name string, url string, pin string, path string, ttl_days int, checked string").withColumn("checked", F.to_date("checked"))
    census = spark.createDataFrame([("f1",)], "path string")
    assert rows(C.source_findings(sources, census, today), "name", "level", "issue") == [("a", "W", "check overdue"), ("b", "E", "file missing"), ("b", "E", "invalid source or pin"), ("b", "I", "no limit"), ("c", "E", "invalid source or pin")]
    docs = spark.createDataFrame(
        [("n", "core", "normative", None, "3", ["add"], None), ("p", "core", "proposed", "t", "9", ["burn"], "2024-01-01"), ("q", "far", "provisional", "t", None, None, None), ("o", None, "odd", "bad", None, [], None), ("adr/1", "core", None, None, None, None, None), ("r", "core", None, None, None, None, None)],
        "id string, domain string, state string, type string, binding string, dynamics array<string>, since string",
    ).withColumn("since", F.to_date("since"))
    refs = spark.createDataFrame([("n", "p"), ("n", "q"), ("p", "n"), ("o", "p")], "src string, dst string")
    pointers = spark.createDataFrame([("n", None, None), ("n", "a.md", False), ("n", "b.md", True), ("n", "c.md", None)], "id string, target string, there boolean")
    setup = C.AuditSetup(["core", "far"], ["normative", "proposed", "provisional"], ["t"], ["add"], registered=["core"])
    assert rows(C.audit_docs(docs, refs, pointers, today, setup), "id", "level", "issue") == [
        ("n", "E", "landed_missing"), ("n", "E", "landed_missing"), ("n", "W", "inversion"), ("n", "W", "landed_without_target"), ("o", "E", "state"), ("o", "E", "type"), ("o", "W", "orphan"),
        ("p", "E", "binding"), ("p", "E", "dynamics"), ("p", "W", "ageing"), ("q", "I", "no_since"), ("q", "W", "undeclared_domain"), ("r", "I", "no_state"),
    ]
    packs = spark.createDataFrame([("good-one", "good-one", "use it when, for, this or that", "b"), ("Bad", "Bad", "short /home/x", "\n" * 600), ("no", "no", None, None), ("x-y", None, "d" * 401, "")], "folder string, name string, description string, body string")
    links = spark.createDataFrame([("good-one", "x.md", True, False), ("good-one", "../y", False, True)], "folder string, target string, dead boolean, outside boolean")
    assert rows(C.package_findings(packs, links), "folder", "level", "issue") == [
        ("Bad", "E", "description_short"), ("Bad", "E", "name"), ("Bad", "W", "body_too_long"), ("Bad", "W", "no_purpose"), ("Bad", "W", "no_triggers"), ("Bad", "W", "path_in_description"), ("good-one", "E", "dead_link"), ("good-one", "E", "link_outside"),
        ("no", "E", "name"), ("no", "E", "no_description"), ("x-y", "E", "no_name"), ("x-y", "W", "description_long"), ("x-y", "W", "no_purpose"), ("x-y", "W", "no_triggers"),
    ]


def test_allowed_edges(spark):
    e = spark.createDataFrame([("a", "a", "link"), ("a", "b", "link"), ("a", "c", "import"), ("b", "a", "link"), ("a", None, "link")], "src_domain string, dst_domain string, kind string")
    rules = spark.createDataFrame([("r", ["a"], ["b"], None), ("v", ["a", "b"], ["c"], ["import", "x"]), ("none", ["b"], [], [])], "rule string, from_in array<string>, to_in array<string>, via array<string>")
    assert sorted(map(repr, rows(G.rule_allowed(e, rules), "rule", "src_domain", "dst_domain"))) == sorted(map(repr, [("none", "b", "a"), ("r", "a", "a"), ("r", "a", "c"), ("r", "a", None)]))


def test_proposals_and_candidates(spark):
    today = F.lit("2024-06-01").cast("date")
    p = spark.createDataFrame([("a", "a", "pending", None, "2024-06-01"), ("b", None, "pending", "t", "2024-05-31"), ("c", "x", "odd", "u", "P30D"), ("d", "d", None, "t", None), ("e", "", "done", "", "2020-01-01")], "stem string, id string, status string, type string, review_after string")
    assert rows(C.proposal_findings(p, today, ["pending", "done"], ["t"]), "stem", "level", "issue") == [("b", "W", "overdue"), ("c", "E", "id_not_stem"), ("c", "E", "status"), ("c", "E", "type"), ("d", "E", "no_status")]
    full = ("d", "p", "r", "g", "2024-05-01")
    c = spark.createDataFrame([(1, "one", 1, *full), (2, "one", 2, *full), (3, "No", 0, None, "", "r", "g", "x"), (4, "pkg", None, "zz", "there", "r", "g", "2020-01-01")], "id long, name string, evidence long, domain string, path string, rationale string, graduation string, opened_at string")
    got = C.candidate_findings(c, today, domains=["d"], packages=spark.createDataFrame([("pkg",)], "name string"), paths=spark.createDataFrame([("there",)], "path string"))
    assert rows(got, "id", "level", "issue") == [(2, "E", "duplicate"), (2, "I", "ready"), (3, "E", "missing:domain"), (3, "E", "missing:path"), (3, "E", "name"), (3, "E", "no_evidence"), (3, "W", "opened_unreadable"), (4, "E", "name_taken"), (4, "I", "ageing"), (4, "W", "domain"), (4, "W", "path_exists")]


def test_checks_report_their_own_failure(spark):
    facts = spark.createDataFrame([("u",)], "unit string")
    checks.register_check("fine", lambda f: f.select(F.lit("r").alias("rule"), F.lit("warn").alias("level"), "unit", F.lit("m").alias("message")), phases=("p1",))
    checks.register_check("boom", lambda f: f.select("absent"), phases=("p1",))
    try:
        assert rows(checks.run_checks(facts, "p1"), "check", "rule") == [("boom", "check-failed"), ("fine", "r")]
        assert checks.run_checks(facts, "p2").count() == 0
        with pytest.raises(ValueError):
            checks.register_check("fine", lambda f: f)
    finally:
        checks.unregister_check("fine"), checks.unregister_check("boom")


def test_scorer_surface(spark):
    pairs = spark.createDataFrame([(i, f"q{i // 10}", f"t{i}") for i in range(25)], "id int, query string, text string").coalesce(1)

    def start():
        def score(query, texts):
            assert len(texts) <= 8
            return [len(query) + len(t) for t in texts]

        return score

    got = R.score_with(pairs, start)
    assert rows(got, "id", "score") == sorted([(i, float(2 + len(f"t{i}"))) for i in range(25)], key=repr)


def test_graph_cycles_and_self_loops(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3), (5, 6)], "src int, dst int")
    roots = spark.createDataFrame([(1,)], "node int")
    assert rows(G.reachable(e, roots)) == [(1,), (2,), (3,)]
    assert G.reachable(e.limit(0), roots).count() == 1
    units = spark.createDataFrame([(3,), (9,)], "unit int")
    assert rows(G.rule_isolated(units, e)) == [(3, 3)]


def reached_by_hand(edges, roots):
    out, todo = set(roots), list(roots)
    while todo:
        s = todo.pop()
        for a, b in edges:
            if a == s and b not in out:
                out.add(b)
                todo.append(b)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_reachable_after_contraction(spark, seed):
    rng = random.Random(seed)
    chains = [(f"c{k}-{i}", f"c{k}-{i + 1}") for k in range(4) for i in range(rng.randint(5, 25))]
    edges = chains + [(f"c{rng.randrange(4)}-{rng.randrange(20)}", f"c{rng.randrange(4)}-{rng.randrange(20)}") for _ in range(rng.randint(0, 12))]
    edges += [(f"ring{i}", f"ring{(i + 1) % 6}") for i in range(6)] + [(f"c0-{i}", f"leaf{i}") for i in range(12)] + [("x", "x"), ("up", "c1-3"), ("c2-2", None)]
    roots = rng.sample(["c0-0", "c1-2", "ring3", "nowhere", "c2-9", "c3-1"], rng.randint(1, 3))
    e = spark.createDataFrame(edges, "src string, dst string")
    got = G.reachable(e, spark.createDataFrame([(r,) for r in roots], "node string"), walk=1 + seed % 2)
    assert {r[0] for r in got.collect()} == reached_by_hand([x for x in edges if None not in x], roots) and got.count() == got.distinct().count()


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds, real = 100_000, [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: rounds.append(1) or real(df))
    e = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert G.reachable(e, spark.createDataFrame([(10,)], "node long")).agg(F.count("*"), F.min("node"), F.max("node")).first() == (n - 9, 10, n)
    assert len(rounds) < 40


def test_new_high_states(spark):
    pts = spark.createDataFrame([("a", 1, 1, 5.0), ("a", 2, 1, 9.0), ("b", 1, 1, 1.0), ("c", 1, 1, 9.0), ("c", 2, 1, 1.0), ("c", 3, 1, 2.0)], "series string, ts int, seq int, value double")
    listed = spark.createDataFrame([(x,) for x in "abcd"], "series string")
    assert rows(R.new_high(pts, listed, 8), "series", "status") == [("a", "new-high"), ("b", "baseline"), ("c", "flat"), ("d", "absence")]
    assert rows(R.new_high(pts, listed, 2), "series", "status")[2] == ("c", "new-high")


def test_ranks_do_not_depend_on_partitions(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a = R.top_k(d.repartition(7), ["lang"], "n_chars", 4, ["doc_id"])
    b = R.top_k(d.coalesce(1), ["lang"], "n_chars", 4, ["doc_id"])
    assert rows(a, "doc_id", "rank") == rows(b, "doc_id", "rank")


def test_eval_summary_by_key_and_over_all(spark):
    data = [("a", False, True, 0.9, 3), ("a", False, None, 0.2, 1), ("b", True, None, 0.1, 2), ("b", False, False, 0.5, 9)]
    df = spark.createDataFrame(data, "k string, oos boolean, top1_hit boolean, top1_score double, ms long").withColumns({"hit3": F.col("top1_hit"), "hit_any": F.col("top1_hit"), "abstain_ok": F.col("oos"), "n_picked": F.lit(1), "band_hit": F.lit(None).cast("boolean")})
    assert rows(A.eval_summary(df, "k"), "k", "in_scope", "top1", "abstain_ok", "p50", "p95") == [("a", 2, 1, 0, 3, 3), ("b", 1, 0, 1, 9, 9)]
    assert rows(A.eval_summary(df), "in_scope", "out_of_scope", "top1", "band_hits", "p50", "p95") == [(3, 1, 1, 0, 3, 9)]


def test_edges_are_counted_before_they_meet_the_units(spark):
    units, e = spark.createDataFrame([(1,), (3,), (None,)], "unit int"), spark.createDataFrame([(3, 3), (3, 4), (5, 3), (None, 4)], "src int, dst int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        df = G.rule_isolated(units, e)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join LeftSemi") < plan.index("Aggregate") and rows(df) == [(3, 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
