"""Findings of round 3: ties of vectors, jobs whose work grew faster than their input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weir.functions import text as X
from weir.operators import decide as D, extract as E, joins as J, ranking as R
from weir.plans import text_plans


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("copies", (641, 1003))
def test_equal_vectors_tie_wherever_they_stand(spark, copies):
    rng = random.Random(copies)
    v = [rng.gauss(0, 1) for _ in range(64)]
    df = spark.range(copies).select("id", F.array(*map(F.lit, v)).alias("v"))
    got = R.score_pairs(df.filter("id = 600"), df, "id", "v", "id", "v", 5).orderBy("rank").collect()
    assert [r["doc"] for r in got] == [0, 1, 2, 3, 4] and len({r["score"] for r in got}) == 1


def test_products_are_added_up_in_order():
    import numpy as np

    from weir.operators.vectors import products

    q, x = np.random.default_rng(1).normal(size=(3, 9)), np.random.default_rng(2).normal(size=(5, 9))
    assert products(q, x).tolist() == [[np.cumsum(u * v).tolist()[-1] for v in x] for u in q]


def test_pairs_of_queries_and_documents_are_not_shuffled(spark):
    docs = spark.range(300).select("id", F.concat(F.lit("apple w"), F.col("id") % 7, F.lit(" pear")).alias("text"), F.lit("apple").alias("title"))
    asked = spark.createDataFrame([(1, "apple w3"), (2, "pear apple"), (3, "nothing")], "qid int, query string")
    got = R.bm25f(asked, docs, {"title": (F.col("title"), 3.0), "text": (F.col("text"), 1.0)}, doc_id="id")
    plan = _plan(got)
    assert plan.count("Exchange hashpartitioning(") == 1 and "hashpartitioning(doc" in plan  # postings only, by document
    assert got.groupBy("qid").count().orderBy("qid").collect() == [(1, 300), (2, 300)]
    best = R.nominate(got, floor=0.9)
    assert "Window" not in _plan(best) and {r["qid"] for r in best.select("qid").distinct().collect()} == {1, 2}
    assert best.agg(F.max("norm")).first()[0] == pytest.approx(1.0)


def test_decisions_meet_their_recipes_in_place(spark):
    rules = D.RuleSet((D.Domain("a", triggers=("go",), members=("m1", "m2")), D.Domain("b", triggers=("stop",))), ready=frozenset({"m1", "m2"}))
    recipes = spark.createDataFrame([("a", "r2", None, "m1", 2), ("a", "r1", "f", "m2", 1), ("a", "+", "f", "m1", 3), ("a", "+", None, "m2", 4)], "domain string, recipe string, flag string, member string, ord int")
    df = spark.createDataFrame([(1, "go"), (2, "go now"), (3, "stop"), (1, "go now")], "id int, text string")
    out = D.assemble_recipe(D.triage(df, rules), recipes, {"f": ["now"]}, rules)
    assert _plan(out).count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in _plan(out)  # texts are looked at once
    got = sorted((r["id"], r["recipe"], r["members"], r["action"]) for r in out.collect())
    assert got == [(1, "r1", ["m2", "m1"], "dispatch"), (1, "r2", ["m1", "m2"], "dispatch"), (2, "r1", ["m2", "m1"], "dispatch"), (3, "", [], "ask")]


def test_clauses_are_cut_alike_with_and_without_negation(spark):
    texts = ["a, b; c!\nd? e", "use x but not y, do not z. but", "don't", "butter but, without", "不要 a，b 但是 c", "", "x。y；", "but", "> q\n```\nf\n```\nz", "~~~\nopen > ", " a\n\n > b\nc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("s", X.strip_markup(F.col("t")))
    active, negated = X.split_clauses(F.col("s"), F.col("s").rlike(X.NEGATION))
    for r in df.select("s", active.alias("a"), negated.alias("n"), X.active_text(F.col("s")).alias("want"), F.array_join(X.clauses(F.col("s"), True), "\n").alias("no")).collect():
        assert (r["a"], r["n"]) == (r["want"], r["no"]), r
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim("t")), r"(?s)```.*?(?:```|\z)|~~~.*?(?:~~~|\z)", ""), r"(?m)^\s*>.*$", "")
    assert all(r[0] == r[1] for r in df.select("s", plain).collect())


def test_modules_are_one_row_throughout(spark):
    names = ["a", "a.ts", "a.tsx", "a.js", "a.jsx", "a.mjs", "a.mts", "a.cts", "b/index.ts", "b/index.js", "b/index.mjs", "c.js", "d", "d/index.js", "e.cts", "f.ts\n"]
    specs = ["./a", "./a.js", "./a.mjs", "./a.cjs", "./b", "./c", "./c.js", "./d", "./e.cjs", "./e", "./z", "lib", None, "./d?x", "./f.js"]
    imports = spark.createDataFrame([("s/m.js", x) for x in specs] + [("s/m.js", "./a"), (None, "./a")], "src string, spec string")
    for some in (names, names[1:], names[3:], names[6:]):
        files = spark.createDataFrame([(f"s/{n}",) for n in some], "path string")
        for suffixes in (J.SUFFIXES, (".ts", "/index.js")):
            want = {}
            for x in {*specs} - {None, "lib"}:
                base = "s/" + x[2:].split("?")[0]
                tries = [base + s for s in suffixes] + [re.sub(r"\.(m|c)?js$", lambda m: f".{m[1] or str()}ts", base)]
                want[x] = next((t for t in tries if t in {f"s/{n}" for n in some}), None)
            out = J.resolve_specs(imports, files, suffixes=suffixes)
            assert out.count() == len(specs) + 2
            assert "posexplode" not in _plan(out)
            for r in out.collect():
                if r["spec"] is None:
                    assert r["external"] is None and r["dead"] is None and r["resolved"] is None
                elif r["src"] is not None:
                    assert r["resolved"] == want.get(r["spec"]), (r, some, suffixes)
                    assert r["dead"] == (r["spec"] != "lib" and want[r["spec"]] is None)


def test_elements_are_handed_on_in_parts(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "<p>" + "<a href='x'>yy</a>" * i + "</p>") for i in range(30)] + [(99, None)], "id long, h string").coalesce(1)
    want = E.html_elements(pages, "id", "h", "a").orderBy("id", "ord").collect()
    assert len(want) == sum(range(30)) and want[-1]["ord"] == 28 and want[0]["attrs"] == {"href": "x"}
    monkeypatch.setattr(E, "PART", 10)
    assert E.html_elements(pages, "id", "h", "a").orderBy("id", "ord").collect() == want


def test_texts_made_from_short_rows_are_dealt(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(text_plans, "TEXTS_A_TASK", 10)
    spark.range(1, 201, numPartitions=1).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    out = text_plans.x26_id_sites(spark, str(tmp_path))
    found = out.select("doc", "line_no", "id", "mode", F.spark_partition_id().alias("task")).collect()
    for mode in ("heading", "bold", "table", "json", "section_list", "filename"):
        assert len({r["task"] for r in found if r["mode"] == mode}) > 10, mode
    want = {(k, n, f"{c}{k % 7 if c == 'L' else k}", mode) for k in range(1, 201) for n, c, mode in ((3, "O", "heading"), (4, "L", "bold"), (5, "T", "table"), (6, "J", "json"), (1, "F", "filename"))}
    assert {tuple(r)[:4] for r in found} == want | {(k, 2, "B1", "section_list") for k in range(1, 201)} and len(found) == 1200
    spark.range(0).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "none/customer.parquet"))
    assert text_plans.x26_id_sites(spark, str(tmp_path / "none")).count() == 0
