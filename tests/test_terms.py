"""Terms as rows, against the patterns of single terms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weir.functions.patterns import flex_pattern, flex_variants
from weir.operators import contracts as C
from weir.operators import joins as J
from weir.operators import terms as M

WORDS = ["box", "boxes", "fox-trot", "city", "cities", "a_b", "c++", ".net", "read", "only", "日本", "go", "-x", "bus", "ss", "1", "é"]
GLUE = [" ", "  ", ", ", "-", "\n", "", ".", "_", "/"]
TERMS = ["box", "Boxes", "fox", "fox-trot", "city", "cities", "read only", "read, only", "c++", ".net", "net", "-x", "x-", "日本", "日本go", "go日", "city go", "c++ read only", "1", "a_b", "ss", "  ", " ", "", "read  only box", "é", "éé", "bus bus", "++", "_", "İx", "box."]


def texts(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice(GLUE) for _ in range(rng.randint(0, 14))) for _ in range(300)]


def test_forms(spark):
    terms = [t for t in TERMS if t] + ["dishes", "Potato", "glass", "flies", "bus", "dies"]
    got = spark.createDataFrame([(t,) for t in terms], "t string").select("t", M.flex_forms(F.col("t")).alias("f")).collect()
    assert {r["t"]: set(r["f"]) for r in got} == {t: set(flex_variants(t)) for t in terms}


@pytest.mark.parametrize("seed", [1, 2])
def test_table_equals_patterns(spark, seed):
    said = [*texts(seed), None, "", "box " * 3000, "READ ONLY"]
    docs = spark.createDataFrame(list(enumerate(said)), "id long, text string").withColumns({c: F.lit("mine") for c in ("doc", "key", "term", "low", "tokens", "before")})
    table = spark.createDataFrame([(t,) for t in [*TERMS, None, "box"]], "name string")
    got = sorted(map(tuple, M.match_term_table(docs, table, "id", "text", "name").collect()))
    assert got == sorted((i, t) for i, s in enumerate(said) for t in set(TERMS) if s and t and re.search(flex_pattern(t), s.lower()))
    literal = J.match_terms(docs.select("id", "text"), [t for t in set(TERMS) if t], "id", "text")
    assert got == sorted(map(tuple, literal.collect()))


def test_plain_terms_and_index(spark):
    docs = spark.createDataFrame([(1, "the box, boxes"), (2, "a box"), (3, None)], "id long, text string")
    names = spark.createDataFrame([("box",), ("Gear",), ("boxes",)], "name string")
    assert sorted(map(tuple, C.index_findings(names, docs, "id", "text").collect())) == [("Gear", 0), ("box", 2), ("boxes", 1)]
    none = names.limit(0)
    assert M.match_term_table(docs, none, "id", "text", "name").count() == 0 and M.match_term_table(docs.limit(0), names, "id", "text", "name").count() == 0


def test_many_terms_one_plan(spark):
    docs = spark.createDataFrame([(i, f"word{i} and word{i + 1} of") for i in range(500)], "id long, text string")
    table = spark.range(100_000).select(F.concat(F.lit("word"), "id").alias("term")).unionByName(spark.range(400).select(F.concat(F.lit("word"), "id", F.lit(" and word"), F.col("id") + 1).alias("term")))
    plans = [M.match_term_table(docs, t, "id", "text") for t in (table.limit(10), table)]
    sizes = [len(p._jdf.queryExecution().optimizedPlan().toString()) for p in plans]
    assert sizes[1] < 1.2 * sizes[0]
    assert plans[1].count() == 500 * 2 + 400


def test_no_text_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b c")], "id long, text string")
    names = spark.createDataFrame([("b c",)], "term string")
    plan = M.match_term_table(docs, names, "id", "text")._jdf.queryExecution().sparkPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = M.match_term_table(docs, names, "id", "text")
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan and any("Exchange hashpartitioning" in x for x in lines)
    assert not any("Exchange" in x and ("text" in x or "low" in x or "tokens" in x) for x in lines)
    assert df.count() == 1


def test_phrase_hits(spark):
    docs = spark.createDataFrame([("One two, THREE.",), ("four-five",), (None,)], "text string")
    forms = spark.createDataFrame([("two three",), ("one/two three",), ("three four",), ("five",), ("",), ("t",)], "form string")
    assert sorted(r[0] for r in M.phrase_hits(docs, forms, "text").collect()) == ["five", "one/two three", "two three"]


def test_flex_terms_look_at_a_text_once(spark, sf):
    from weir.plans import registry

    df = registry.queries()["x4_flex_terms"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and plan.count("regexp_extract_all") == 1


def test_only_likely_stretches_leave_a_row(spark):
    docs = spark.createDataFrame([(i, f"w{i} of the box, and w{i + 1} of city go; the bus") for i in range(200)], "doc long, low string")
    keys = spark.createDataFrame([("box",), ("city go",), ("go bus",)], "key string").withColumn("runs", F.size(F.split("key", " ")))
    found = M._likely_of(docs, keys, "runs", f"[^{M.RUN}]+", 0)
    assert found.groupBy("key").count().collect() and {r["key"]: r["count"] for r in found.groupBy("key").count().collect()} == {"box": 200, "city go": 200}
    around = {tuple(r) for r in M._likely_of(docs, keys, "runs", f"[^{M.RUN}]+", 2).select("key", "before", "after").collect()}
    assert around == {("box", " ", ", "), ("city go", " ", "; ")}
    empty = M._likely_of(docs.limit(0), keys, "runs", None, 0)
    assert empty.count() == 0 and M._likely_of(docs, keys.limit(0), "runs", None, 0) is None
