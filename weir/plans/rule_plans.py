"""Rule queries: triage decisions, evaluation of scores, graph contracts, data-quality contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import flex_pattern
from ..functions.text import MODES
from ..operators import contracts as C
from ..operators import decide as D
from ..operators import docclass as DC
from ..operators import extract as E
from ..operators import filters as L
from ..operators import graph as G
from ..operators import joins as J
from ..operators import ranking as R
from .kit import Book, t
from .table_plans import PAIRS, TERM_TABLE, _pairs, benchmark_terms, documents, order_flows

book = Book()
query = book.query
QUERIES, ORACLES = book.queries, book.oracles

RULES = D.RuleSet(
    domains=(
        D.Domain("law", triggers=("license", "apache"), weak=("version",), members=("licensing",), default_recipe="law-base"),
        D.Domain("prose", triggers=("there", "which"), weak=("that",), negatives=("which was",), members=("editing",), default_recipe="prose-base"),
        D.Domain("german", triggers=("nicht", "auch"), quality=("gilt",), weak=("und",), members=("deutsch",), default_recipe="german-base"),
    ),
    conflict=("law", ("german",), "prose"),
    ready=frozenset({"licensing", "editing", "deutsch"}),
    recipes={"law-base": ("licensing",), "prose-base": ("editing",), "german-base": ("deutsch",)},
)


def _n(terms, s="s"):
    return " + ".join(f"CAST(regexp_matches({s}, '{flex_pattern(x)}') AS INTEGER)" for x in terms) or "0"


def scores_sql(source: str) -> str:
    """source: a SELECT of doc_id and text. `but` between word borders ends a clause; it is replaced twice, as neighbours share a border."""
    return rf"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(lower(trim(coalesce(text, ''))), '(?s)```.*?(?:```|\z)|~~~.*?(?:~~~|\z)', '', 'g'), '(?m)^\s*>.*$', '', 'g') AS raw FROM ({source})),
b AS (SELECT doc_id, raw, regexp_replace(regexp_replace(raw, '(^|[^a-z0-9_])but($|[^a-z0-9_])', '\1' || chr(10) || '\2', 'g'), '(^|[^a-z0-9_])but($|[^a-z0-9_])', '\1' || chr(10) || '\2', 'g') AS cut FROM a),
c AS (SELECT doc_id, raw, array_to_string(list_filter(regexp_split_to_array(cut, '[，,。；;' || chr(10) || '!?？！]|但是|而是'), lambda x: NOT regexp_matches(x, '(^|[^a-z0-9_])(?:do not|don''t|without|exclude|not using)($|[^a-z0-9_])')), ' ') AS s FROM b),
n AS (SELECT doc_id, raw, s, replace(s, 'which was', '#########') AS m FROM c),
h AS (SELECT doc_id, raw, s, {_n(["license", "apache"])} AS law_s, {_n(["version"])} AS law_w, {_n(["there", "which"], "m")} AS prose_s, {_n(["that"], "m")} AS prose_w, {_n(["nicht", "auch", "gilt"])} AS ger_s, {_n(["und"])} AS ger_w, {_n(["gilt"])} > 0 AS gate FROM n),
d AS (SELECT *, CASE WHEN law_s + law_w > 0 AND ger_s + ger_w > 0 AND prose_s + prose_w = 0 THEN 'mixed' WHEN gate THEN 'german' WHEN law_s > 0 THEN 'law' WHEN prose_s > 0 THEN 'prose' WHEN ger_s > 0 THEN 'german' WHEN law_w > 0 THEN 'law' WHEN prose_w > 0 THEN 'prose' WHEN ger_w > 0 THEN 'german' ELSE 'none' END AS domain FROM h),
t AS (SELECT doc_id, raw, s, CASE WHEN trim(raw) = '' THEN 'none' ELSE domain END AS domain, CASE WHEN trim(raw) = '' OR domain = 'none' THEN 'none' WHEN domain = 'mixed' THEN 'medium' WHEN NOT strong THEN 'low' WHEN score >= 2 THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN trim(raw) = '' OR domain = 'none' THEN 'handoff' WHEN domain = 'mixed' OR NOT strong THEN 'ask' ELSE 'dispatch' END AS action
FROM (SELECT *, CASE domain WHEN 'law' THEN law_s > 0 WHEN 'prose' THEN prose_s > 0 WHEN 'german' THEN ger_s > 0 END AS strong, CASE domain WHEN 'law' THEN law_s + law_w WHEN 'prose' THEN prose_s + prose_w WHEN 'german' THEN ger_s + ger_w END AS score FROM d))
"""


SCORES = scores_sql("SELECT doc_id, text FROM documents")


@query(SCORES + "SELECT doc_id, law_s AS law_strong, law_s + law_w AS law_score, prose_s AS prose_strong, prose_s + prose_w AS prose_score, ger_s AS german_strong, ger_s + ger_w AS german_score FROM d")
def d1_domain_scores(spark, sf_dir):
    rows = D.domain_scores(documents(spark, sf_dir).select("doc_id", "text"), RULES)
    out = [F.col("scores")[i][k].alias(f"{name}_{k}") for i, name in enumerate(("law", "prose", "german")) for k in ("strong", "score")]
    return rows.select("doc_id", *out)


@query(SCORES + "SELECT doc_id, domain FROM d")
def d2_pick_domain(spark, sf_dir):
    return D.pick_domain(D.domain_scores(documents(spark, sf_dir).select("doc_id", "text"), RULES), RULES).select("doc_id", "domain")


@query(SCORES + "SELECT doc_id, domain, confidence, action FROM t")
def d3_triage(spark, sf_dir):
    return D.triage(documents(spark, sf_dir).select("doc_id", "text"), RULES, None, "doc_id").select("doc_id", "domain", "confidence", "action")


def _said(terms) -> str:
    return " OR ".join(f"regexp_matches(s, '{flex_pattern(x)}')" for x in terms)


@query(SCORES + f"""SELECT doc_id, domain, action, CASE WHEN action <> 'dispatch' THEN '' WHEN domain = 'law' AND ({_said(["apache"])}) THEN 'law-apache' ELSE domain || '-base' END AS recipe,
  CASE WHEN action <> 'dispatch' THEN '' WHEN domain = 'law' THEN 'licensing' || CASE WHEN {_said(["there", "that"])} THEN ',editing' ELSE '' END WHEN domain = 'prose' THEN 'editing' ELSE 'deutsch' END AS members FROM t""")
def d4_assemble_recipe(spark, sf_dir):
    decided = D.triage(documents(spark, sf_dir).select("doc_id", "text"), RULES, None, "doc_id")
    recipes = spark.createDataFrame([("law", "law-base", None, "licensing", 2), ("law", "law-apache", "apache", "licensing", 1), ("law", "+", "english", "editing", 3), ("prose", "prose-base", None, "editing", 1), ("german", "german-base", None, "deutsch", 1)], "domain string, recipe string, flag string, member string, ord int")
    out = D.assemble_recipe(decided, recipes, {"apache": ["apache"], "english": ["there", "that"]}, RULES, "doc_id")
    return out.select("doc_id", "domain", "action", "recipe", F.array_join("members", ",").alias("members"))


MODE = r"""CASE WHEN regexp_matches(raw, '(^|[^a-z0-9_])(?:read[- ]only|do not (?:edit|modify|implement|execute)|don''t (?:edit|modify|implement|execute))($|[^a-z0-9_])') OR {review} THEN 'review' WHEN {plan} THEN 'plan' WHEN {explain} THEN 'explain' ELSE 'implement' END""".format(
    **{kind: " OR ".join(f"regexp_matches(raw, '{flex_pattern(x)}')" for x in words if x.isascii()) for kind, words in MODES}
)


@query(SCORES + f"""SELECT doc_id, true AS valid, CASE action WHEN 'handoff' THEN 'handoff' WHEN 'ask' THEN 'ask_clarification' ELSE CASE mode WHEN 'explain' THEN 'overview_explain' ELSE mode END END AS prompt_action,
  CASE WHEN action = 'dispatch' THEN CASE domain WHEN 'law' THEN 'licensing' WHEN 'prose' THEN 'editing' ELSE 'deutsch' END ELSE '' END AS load FROM (SELECT *, {MODE} AS mode FROM t)""")
def d5_adapt(spark, sf_dir):
    decided = D.triage(documents(spark, sf_dir).select("doc_id", "text"), RULES, None, "doc_id")
    recipes = spark.createDataFrame([("law", "law-base", None, "licensing", 1), ("prose", "prose-base", None, "editing", 1), ("german", "german-base", None, "deutsch", 1)], "domain string, recipe string, flag string, member string, ord int")
    out = D.adapt(D.assemble_recipe(decided, recipes, {}, RULES, "doc_id"), [d.name for d in RULES.domains])
    return out.select("doc_id", "valid", "prompt_action", F.array_join("load", ",").alias("load"))


def _cases(spark, sf_dir):
    lab = t(spark, sf_dir, "labels").join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    expect = F.struct(F.when(F.col("lang") != "es", F.col("lang")).alias("domain"), F.lit(None).cast("string").alias("action"), F.when(F.col("toxic") == 1, F.array(F.lit("ask"), F.lit("dispatch"))).alias("actionIn"), F.when(F.col("quality") == 1, F.array(F.lit("keep"))).alias("skills"), F.lit(None).cast("array<string>").alias("anySkills"), F.lit(None).cast("array<double>").alias("band"))
    cases = lab.select(F.col("doc_id").alias("id"), expect.alias("expect"))
    decided = lab.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "en").otherwise(F.col("lang")).alias("domain"), F.when(F.col("doc_id") % 2 == 0, "ask").otherwise("handoff").alias("action"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("keep"))).otherwise(F.array(F.lit("drop"))).alias("candidates"))
    return decided, cases


@query("""
SELECT doc_id AS id, concat_ws(',', CASE WHEN lang <> 'es' AND doc_id % 5 = 0 AND lang <> 'en' THEN 'domain' END, CASE WHEN toxic = 1 AND doc_id % 2 <> 0 THEN 'actionIn' END, CASE WHEN quality = 1 AND doc_id % 3 <> 0 THEN 'skills' END) AS fails,
  NOT (lang <> 'es' AND doc_id % 5 = 0 AND lang <> 'en') AND NOT (toxic = 1 AND doc_id % 2 <> 0) AND NOT (quality = 1 AND doc_id % 3 <> 0) AS pass FROM labels JOIN documents USING (doc_id)
""")
def d6_check_cases(spark, sf_dir):
    return D.check_cases(*_cases(spark, sf_dir)).select("id", F.array_join("fails", ",").alias("fails"), "pass")


@query("""
SELECT doc_id AS id, CASE WHEN quality = 1 THEN doc_id % 3 = 0 END AS hit_any, CASE WHEN quality = 1 THEN doc_id % 3 = 0 END AS hit_all, CASE WHEN toxic = 1 THEN doc_id % 2 <> 0 END AS abstain_ok FROM labels JOIN documents USING (doc_id)
""")
def d7_dump_hits(spark, sf_dir):
    decided, cases = _cases(spark, sf_dir)
    wanted = cases.select("id", F.coalesce("expect.skills", F.array().cast("array<string>")).alias("wanted"), F.col("expect.actionIn").isNotNull().alias("oos"))
    return D.dump_hits(decided, wanted)


BY_LABEL = f"SELECT qid, qlabel, dlabel AS item, round(max(score), 6) AS score FROM ({PAIRS}) WHERE qid <> doc GROUP BY 1, 2, 3"
LABELS = "SELECT vec_id AS qid, CASE WHEN label = 0 THEN CAST([] AS INTEGER[]) ELSE [label] END AS wanted, label = 0 AS oos FROM embeddings WHERE vec_id % 100 = 0"


def by_label(spark, sf_dir):
    """(qid, item, score): the best score of each label's vectors for each query."""
    e = t(spark, sf_dir, "embeddings")
    best = R.best_by(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", "label").withColumn("score", F.round("score", 6))
    labels = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.when(F.col("label") == 0, F.array().cast("array<int>")).otherwise(F.array("label")).alias("wanted"), (F.col("label") == 0).alias("oos"))
    return best.select("qid", "item", "score"), labels


@query(f"""
WITH s AS ({BY_LABEL}), l AS ({LABELS}), p AS (SELECT qid, list(item ORDER BY item) AS picked FROM s WHERE score >= 0.3 GROUP BY 1)
SELECT qid, array_to_string(coalesce(picked, []), ',') AS picked, CASE WHEN len(wanted) > 0 THEN coalesce(list_has_any(wanted, picked), false) END AS hit_any, CASE WHEN oos THEN picked IS NULL END AS abstain_ok FROM l LEFT JOIN p USING (qid)
""")
def d8_eval_threshold(spark, sf_dir):
    out = D.eval_threshold(*by_label(spark, sf_dir), 0.3)
    return out.select("qid", F.array_join(F.col("picked").cast("array<string>"), ",").alias("picked"), "hit_any", "abstain_ok")


@query(f"""
WITH s AS ({BY_LABEL}), l AS ({LABELS}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS k FROM s), b AS (SELECT qid, max(CASE WHEN k = 1 THEN item END) AS top, round(max(CASE WHEN k = 1 THEN score END), 4) AS top1_p FROM r GROUP BY 1)
SELECT qid, CASE WHEN top <> 3 THEN top END AS picked, top1_p, CASE WHEN len(wanted) > 0 THEN top <> 3 AND list_contains(wanted, top) END AS hit, CASE WHEN oos THEN top = 3 END AS abstain_ok FROM l JOIN b USING (qid)
""")
def d9_eval_choice(spark, sf_dir):
    out = D.eval_choice(*by_label(spark, sf_dir), none=3)
    return out.select("qid", "picked", F.round("top1_p", 4).alias("top1_p"), "hit", "abstain_ok")


@query(f"""
WITH s AS ({BY_LABEL}), l AS ({LABELS}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS k FROM s), h AS (SELECT qid, item, round(1 - score, 6) AS s2 FROM r WHERE k <= 3),
b AS (SELECT qid, count(*) AS short_n, max(s2) AS rr_max, max_by(item, s2 * 1000000 - item / 100) AS rr_top1 FROM h GROUP BY 1)
SELECT qid, short_n, rr_top1, round(rr_max, 4) AS rr_max, CASE WHEN rr_max >= 0.7 THEN rr_top1 END AS picked, CASE WHEN len(wanted) > 0 THEN list_contains(wanted, rr_top1) END AS rr_hit, CASE WHEN len(wanted) > 0 THEN coalesce(list_contains(wanted, CASE WHEN rr_max >= 0.7 THEN rr_top1 END), false) ELSE rr_max < 0.7 END AS hit FROM l JOIN b USING (qid)
""")
def d10_hybrid(spark, sf_dir):
    s, labels = by_label(spark, sf_dir)
    out = D.hybrid(s, s.withColumn("score", F.round(1 - F.col("score"), 6)), labels, 3, 0.7)
    return out.withColumn("rr_max", F.round("rr_max", 4))


@query(f"""
WITH s AS ({BY_LABEL}), l AS ({LABELS}), sc AS (SELECT qid, max(score) AS score FROM s GROUP BY 1), g AS (SELECT qid, item % 3 AS domain FROM s JOIN sc USING (qid) WHERE sc.score >= 0.2 GROUP BY qid, item % 3 HAVING max(s.score) >= 0.25),
c AS (SELECT s.qid, s.item, s.score FROM s JOIN g ON g.qid = s.qid AND s.item % 3 = g.domain), b AS (SELECT qid, item AS picked FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS k FROM c) WHERE k = 1)
SELECT l.qid, coalesce(sc.score >= 0.2, false) AS in_scope, (SELECT string_agg(domain, ',' ORDER BY domain) FROM g WHERE g.qid = l.qid) AS doms, (SELECT count(*) FROM c WHERE c.qid = l.qid) AS short_n, picked, CASE WHEN len(wanted) > 0 THEN coalesce(list_contains(wanted, picked), false) ELSE picked IS NULL END AS hit
FROM l LEFT JOIN sc ON sc.qid = l.qid LEFT JOIN b ON b.qid = l.qid
""")
def d11_two_stage(spark, sf_dir):
    s, labels = by_label(spark, sf_dir)
    scope = s.groupBy("qid").agg(F.max("score").alias("score"))
    gates = s.groupBy("qid", (F.col("item") % 3).alias("domain")).agg(F.max("score").alias("score"))
    members = t(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("domain"), F.col("label").alias("item")).distinct()
    out = D.two_stage(scope, gates, members, s, labels, 0.2, 0.25)
    return out.select("qid", "in_scope", F.array_join(F.col("doms").cast("array<string>"), ",").alias("doms"), "short_n", "picked", "hit")


@query(f"SELECT qid, CASE WHEN qid % 200 = 0 THEN max(score) BETWEEN 0.2 AND 0.6 END AS band_hit FROM (SELECT qid, round(score, 6) AS score FROM ({PAIRS}) WHERE qid <> doc) GROUP BY 1")
def d12_band_hits(spark, sf_dir):
    rows = _pairs(spark, sf_dir, 2).filter("qid <> doc").groupBy("qid").agg(F.round(F.max("score"), 6).alias("top1_score")).withColumn("band", F.when(F.col("qid") % 200 == 0, F.array(F.lit(0.2), F.lit(0.6))))
    return D.band_hits(rows).select("qid", "band_hit")


CLASS = """CASE WHEN s >= 0.5 AND inside THEN 'agree' WHEN go AND NOT inside AND s >= 0.5 THEN 'model-diverges' WHEN NOT go AND s >= 0.5 THEN 'model-finds-gap' WHEN go AND s < 0.05 THEN 'router-overfires' WHEN s BETWEEN 0.05 AND 0.45 THEN 'gray' WHEN inside THEN 'agree' ELSE 'low-agree' END"""
DISAGREE = f"SELECT doc_id, {CLASS} AS class FROM (SELECT doc_id, (n_chars % 100) / 100.0 AS s, n_chars % 3 = 0 AS inside, doc_id % 2 = 0 AS go FROM documents)"


def classed(spark, sf_dir):
    d = documents(spark, sf_dir)
    rows = d.select("doc_id", ((F.col("n_chars") % 100) / 100.0).alias("score"), F.lit("x").alias("top1"), F.when(F.col("doc_id") % 2 == 0, "dispatch").otherwise("ask").alias("action"), F.when(F.col("n_chars") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("y"))).alias("dispatched"))
    return D.disagreement(rows).select("doc_id", "class")


@query(DISAGREE)
def d13_disagreement(spark, sf_dir):
    return classed(spark, sf_dir)


@query(f"SELECT class, count(*) AS n FROM ({DISAGREE}) GROUP BY 1")
def a22_class_counts(spark, sf_dir):
    from ..operators.aggregates import class_counts

    return class_counts(classed(spark, sf_dir))


KEY = r"trim(regexp_replace(lower(%s), '[ \t\n\r\f\x0B]+', ' ', 'g'))"


@query(rf"""
WITH u AS (SELECT text, conv_id * 1000 + turn AS ts, {KEY % 'text'} AS k FROM conversations WHERE role = 'user' AND text IS NOT NULL), f AS (SELECT k, min_by(text, ts) AS query, min(ts) AS ts FROM u WHERE k <> '' AND k NOT IN (SELECT {KEY % 'text'} FROM benchmark) GROUP BY 1),
n AS (SELECT query, 2 + row_number() OVER (ORDER BY ts) AS n FROM f)
SELECT 'b-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id, md5(query) AS digest, 'en' AS lang, '' AS expect FROM n
""")
def d14_harvest(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").filter("role = 'user' AND text IS NOT NULL").select(F.col("text").alias("hint"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ts"))
    existing = spark.createDataFrame([("b-002",)], "id string")
    return D.harvest(c, [(t(spark, sf_dir, "benchmark"), "text")], existing).select("id", F.md5(F.col("query").cast("binary")).alias("digest"), "lang", "expect")


PREC = ["there", "with", "license"]


@query(f"WITH c AS ({DISAGREE}), h AS (SELECT unnest(['there', 'with', 'license']) AS term), d AS (SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents) SELECT term, count(*) FILTER (class = 'router-overfires') AS overfires, count(*) FILTER (class = 'agree') AS agrees FROM ("
       + " UNION ALL ".join(f"SELECT doc_id, '{x}' AS term FROM d WHERE regexp_matches(s, '{flex_pattern(x)}')" for x in PREC) + ") JOIN c USING (doc_id) GROUP BY 1")
def d15_term_precision(spark, sf_dir):
    hits = J.match_terms(documents(spark, sf_dir), PREC, "doc_id", "text")
    return D.term_precision(hits, classed(spark, sf_dir).withColumnRenamed("doc_id", "doc"))


# graph: orders as edges from customers to order status, parts to suppliers
@query(r"""
WITH e AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS a, regexp_extract(html, 'href="([^"]*)"', 1) AS b FROM pages)
SELECT page_id, CASE WHEN starts_with(a, 'blog.') THEN 'blog' WHEN starts_with(a, 'm.') THEN 'mobile' ELSE '__other__' END AS src_domain, CASE WHEN length(b) > 8 THEN '__dead__' WHEN starts_with(b, '/d') THEN '__other__' ELSE 'rooted' END AS dst_domain FROM e
""")
def g1_edges(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("file"), F.regexp_extract("html", 'href="([^"]*)"', 1).alias("to"))
    facts = p.withColumns({"dead": F.length("to") > 8, "external": F.lit(False), "to": F.when(F.col("to").startswith("/d"), F.col("to")).otherwise(F.concat(F.lit("r"), "to"))})
    out = G.edges(facts.withColumn("file", F.regexp_replace("file", r"\.", "/")), [("blog", "blog/**"), ("mobile", "m/**"), ("rooted", "r/**|r")])
    return out.select("page_id", "src_domain", "dst_domain")


@query("SELECT 'dead-edge' AS rule, CAST(l_orderkey AS VARCHAR) AS unit, CAST(l_partkey AS VARCHAR) AS observed FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def g2_dead_edges(spark, sf_dir):
    known = t(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("dst"), F.lit(False).alias("dead"))
    e = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).join(known, "dst", "left").withColumn("dead", F.coalesce("dead", F.lit(True)))
    return G.dead_edges(e).select("rule", "unit", "observed")


FLOW = "SELECT o_orderkey, CAST(cn.n_regionkey AS VARCHAR) AS src, CAST(sn.n_regionkey AS VARCHAR) AS dst, o_orderstatus AS kind FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey"


@query(f"SELECT rule, count(*) AS n FROM (SELECT 'no-0-to-1' AS rule FROM ({FLOW}) WHERE src = '0' AND dst = '1' UNION ALL SELECT 'no-f-to-2' FROM ({FLOW}) WHERE dst = '2' AND kind = 'F') GROUP BY 1")
def g3_forbidden(spark, sf_dir):
    rules = spark.createDataFrame([("no-0-to-1", "0", "1", None), ("no-f-to-2", None, "2", "F")], "rule string, src_domain string, dst_domain string, via string")
    return G.rule_forbidden(order_flows(spark, sf_dir), rules).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""
SELECT 'r0' AS rule, dst AS dst_domain, count(*) AS n FROM ({FLOW}) WHERE src = '0' AND dst NOT IN ('2', '3') GROUP BY 2
UNION ALL SELECT 'r12', dst, count(*) FROM ({FLOW}) WHERE src IN ('1', '2') AND kind IN ('F', 'P') AND dst <> '1' GROUP BY 2
""")
def g4_allowed(spark, sf_dir):
    rules = spark.createDataFrame([("r0", ["0"], ["2", "3"], None), ("r12", ["1", "2"], ["1"], ["F", "P"])], "rule string, from_in array<string>, to_in array<string>, via array<string>")
    return G.rule_allowed(order_flows(spark, sf_dir), rules).groupBy("rule", "dst_domain").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS unit FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice <= 400000)")
def g5_required(spark, sf_dir):
    e = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), "o_orderstatus", (F.col("o_totalprice") > 400000).alias("dead"))
    return G.rule_required(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit")), e, "unit", F.col("o_orderstatus") == "P")


@query("SELECT p_partkey AS unit FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def g6_covered(spark, sf_dir):
    return G.rule_covered(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit")), t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("dst"), "l_quantity"), good=F.col("l_quantity") > 48)


@query("WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem) SELECT unit, count(*) AS edges FROM (SELECT src AS unit FROM e UNION ALL SELECT dst FROM e WHERE src <> dst) WHERE unit IN (SELECT p_partkey FROM part) GROUP BY 1")
def g7_isolated(spark, sf_dir):
    e = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return G.rule_isolated(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit")), e)


#: The parts of an order follow each other: an edge from each line's part to that of the next line; the root is the first part of the first order.
@query("""
WITH RECURSIVE e AS (SELECT DISTINCT a.l_partkey AS s, b.l_partkey AS d FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
r(n) AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) AND l_linenumber = 1 UNION SELECT d FROM e JOIN r ON s = n)
SELECT p_partkey AS unit FROM part WHERE p_partkey NOT IN (SELECT n FROM r)
""")
def g8_reachable(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    e = li.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst")
    roots = li.join(li.agg(F.min("l_orderkey").alias("l_orderkey")), "l_orderkey").filter("l_linenumber = 1").select(F.col("l_partkey").alias("unit"))
    return G.rule_reachable(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit")), e, roots)


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages), b AS (SELECT path, list_last(string_split(path, '/')) AS n FROM p)
SELECT path, 'name_match' AS issue FROM b WHERE NOT regexp_matches(n, '^[^/]*[.]html$') AND NOT regexp_matches(n, '^[1-4][^/]*$') UNION ALL SELECT path, 'name_not_match' FROM b WHERE regexp_matches(n, '^9[^/]*$')
""")
def g9_attrs(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return G.rule_attrs(p, "path", ["*.html", "1*", "2*", "3*", "4*"], ["9*"])


@query("""
WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS unit, o_orderpriority AS rule, CASE WHEN o_orderstatus = 'F' THEN 'forbidden' ELSE 'covered' END AS family, o_orderkey FROM orders)
SELECT o_orderkey FROM f WHERE family = 'forbidden' OR NOT (unit LIKE '1%' OR (unit = '7' AND rule = '1-URGENT') OR unit = '8')
""")
def g11_exemptions(spark, sf_dir):
    f = t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("unit"), F.col("o_orderpriority").alias("rule"), F.when(F.col("o_orderstatus") == "F", "forbidden").otherwise("covered").alias("family"), "o_orderkey")
    ex = spark.createDataFrame([("7", "1-URGENT", "old"), ("8", None, "moved"), ("9", None, "")], "unit string, rule string, reason string")
    return G.apply_exemptions(f, ex, [("1*", "", "legacy"), ("2*", "", " ")]).select("o_orderkey")


@query("SELECT node, sum(o) AS n_out, sum(i) AS n_in FROM (SELECT o_custkey AS node, 1 AS o, 0 AS i FROM orders UNION ALL SELECT o_orderkey, 0, 1 FROM orders) GROUP BY 1")
def g12_degrees(spark, sf_dir):
    return G.degrees(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")))


CLASSES = [
    {"class": "page", "match": {"name": ["*.html", "*a*"]}},
    {"class": "french", "match": {"path": ["**/fr/*"], "notPath": ["blog*/**"]}},
    {"class": "some", "match": {"any": [{"path": ["**/de/**"], "any": [{"name": "*1*"}, {"name": "*2*"}]}, {"path": "*.org/**", "notPath": "**/es/**"}]}},
    {"class": "rest", "match": {"path": ["**", "**/*.*/**"]}},
]


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS p FROM pages), q AS (SELECT *, list_last(string_split(p, '/')) AS b FROM p),
m AS (SELECT *, regexp_matches(b, '^[^/]*[.]html$') AND contains(b, 'a') AS page, regexp_matches(p, '^(?:[^/]+/)*fr/[^/]*$') AND NOT regexp_matches(p, '^blog[^/]*/.*$') AS french,
  (regexp_matches(p, '^(?:[^/]+/)*de/.*$') AND (contains(b, '1') OR contains(b, '2'))) OR (regexp_matches(p, '^[^/]*[.]org/.*$') AND NOT regexp_matches(p, '^(?:[^/]+/)*es/.*$')) AS chosen,
  regexp_matches(p, '^(?:[^/]+/)*[^/]*[.][^/]*/.*$') AS rest FROM q)
SELECT page_id, CASE WHEN page THEN 'page' WHEN french THEN 'french' WHEN chosen THEN 'some' WHEN rest THEN 'rest' END AS class FROM m
""")
def c1_classify_docs(spark, sf_dir):
    return DC.classify_docs(t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("rel")), CLASSES).select("page_id", "class")


SPEC = [
    {
        "class": "event", "match": {"path": ["**"]}, "required": ["kind", "k"], "freshness": {"anyOf": ["day", "seen"], "level": "warn"}, "states": {"field": "kind", "vocab": ["view", "click", "error", ""], "tolerate": ["signup"]},
        "conditional": [{"when": {"kind": "error"}, "require": ["k", "note"]}],
    }
]


def _fields_docs(spark, sf_dir):
    """Events as documents: every eleventh has no header, every seventh has an empty kind, every fifth a day."""
    e, i = t(spark, sf_dir, "events"), F.col("event_id")
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    pairs = F.array_compact(F.array(pair("kind", F.when(i % 7 == 0, "").otherwise(F.col("event_type"))), F.when(i % 3 != 0, pair("k", F.get_json_object("props", "$.k"))), F.when(i % 5 == 0, pair("day", F.lit("")))))
    return e.select(i.cast("string").alias("rel"), F.when(i % 11 != 0, F.map_from_entries(pairs)).alias("fields"))


EVENT_DOCS = """
WITH e AS (SELECT CAST(event_id AS VARCHAR) AS rel, event_id % 11 <> 0 AS there, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS kind,
  CASE WHEN event_id % 11 <> 0 AND event_id % 3 <> 0 THEN json_extract_string(props, '$.k') END AS k, event_id % 11 <> 0 AND event_id % 5 = 0 AS dated FROM events),
f AS (SELECT rel, 'required' AS rule, 'error' AS level, 'kind' AS field FROM e WHERE coalesce(kind, '') = '' UNION ALL SELECT rel, 'required', 'error', 'k' FROM e WHERE coalesce(k, '') = ''
  UNION ALL SELECT rel, 'freshness', 'warn', '' FROM e WHERE NOT dated UNION ALL SELECT rel, 'states', 'error', 'kind' FROM e WHERE kind NOT IN ('view', 'click', 'error', '', 'signup')
  UNION ALL SELECT rel, 'conditional', 'error', 'note' FROM e WHERE kind = 'error' UNION ALL SELECT rel, 'conditional', 'error', 'k' FROM e WHERE kind = 'error' AND coalesce(k, '') = '')
"""


@query(EVENT_DOCS + "SELECT * FROM f")
def c2_docclass_findings(spark, sf_dir):
    return DC.docclass_findings(_fields_docs(spark, sf_dir), SPEC, F.lit("2024-02-01").cast("date")).select("rel", "rule", "level", "field")


@query(EVENT_DOCS + "SELECT count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warn') AS warnings, (SELECT count(*) FROM e) AS classified, 0 AS unclassified FROM f")
def c6_docclass_counts(spark, sf_dir):
    d = _fields_docs(spark, sf_dir)
    return DC.docclass_counts(DC.classify_docs(d, SPEC), DC.docclass_findings(d, SPEC, F.lit("2024-02-01").cast("date")))


@query("""
SELECT l_orderkey, 'nonnegative' AS rule, 'l_discount' AS field FROM lineitem WHERE l_discount - 0.05 < 0 UNION ALL SELECT l_orderkey, 'enum', 'l_returnflag' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT l_orderkey, 'charge', 'l_extendedprice * l_tax < 5000' FROM lineitem WHERE NOT l_extendedprice * l_tax < 5000
""")
def c8_validate_table(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").withColumn("l_discount", F.col("l_discount") - 0.05)
    rules = [{"rule": "required", "field": "l_shipdate"}, {"rule": "nonnegative", "field": "l_discount"}, {"rule": "enum", "field": "l_returnflag", "values": ["A", "N"]}, {"rule": "holds", "name": "charge", "expr": "l_extendedprice * l_tax < 5000"}]
    return C.validate_table(li, rules, "l_orderkey").select("l_orderkey", "rule", "field")


@query("""
WITH o AS (SELECT o_orderkey AS stem, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS id, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS status,
  CASE WHEN o_orderkey % 8 <> 0 THEN o_orderpriority END AS type, CASE WHEN o_orderkey % 5 = 0 THEN 'P30D' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS review, o_orderkey % 17 <> 0 AS there FROM orders)
SELECT stem, 'E' AS level, 'no_header' AS issue FROM o WHERE NOT there UNION ALL SELECT stem, 'E', 'id_not_stem' FROM o WHERE there AND id = 'x' UNION ALL SELECT stem, 'E', 'no_status' FROM o WHERE there AND status IS NULL
UNION ALL SELECT stem, 'E', 'status' FROM o WHERE there AND status = 'F' UNION ALL SELECT stem, 'E', 'type' FROM o WHERE there AND type NOT IN ('1-URGENT', '2-HIGH', '5-LOW')
UNION ALL SELECT stem, 'W', 'overdue' FROM o WHERE there AND status = 'pending' AND review <> 'P30D' AND review < '1996-06-01'
""")
def c10_proposals(spark, sf_dir):
    k = F.col("o_orderkey")
    o = t(spark, sf_dir, "orders").select(
        k.alias("stem"), F.when(k % 9 == 0, F.lit(None)).when(k % 10 == 0, "x").otherwise(k.cast("string")).alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").when(k % 13 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(k % 8 != 0, F.col("o_orderpriority")).alias("type"), F.when(k % 5 == 0, "P30D").otherwise(F.to_date("o_orderdate").cast("string")).alias("review_after"), (k % 17 != 0).alias("there"),
    )
    return C.proposal_findings(o, F.lit("1996-06-01").cast("date"), ["O", "pending"], ["1-URGENT", "2-HIGH", "5-LOW"], header="there")


@query("""
WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'C_' || o_custkey ELSE 'c-' || o_custkey END AS name, floor(o_totalprice / 100000) AS ev, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS domain, CASE WHEN o_orderkey % 4 <> 0 THEN 'p' || o_orderkey END AS path,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_clerk END AS rationale, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 12 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS opened FROM (SELECT *, 'clerk' AS o_clerk FROM orders)),
d AS (SELECT *, min(id) OVER (PARTITION BY name) AS first, try_cast(opened AS DATE) AS day FROM o)
SELECT id, 'E' AS level, 'name' AS issue FROM d WHERE name LIKE 'C%' UNION ALL SELECT id, 'E', 'missing:domain' FROM d WHERE domain IS NULL UNION ALL SELECT id, 'E', 'missing:path' FROM d WHERE path IS NULL UNION ALL SELECT id, 'E', 'missing:rationale' FROM d WHERE rationale = ''
UNION ALL SELECT id, 'E', 'missing:opened_at' FROM d WHERE opened IS NULL UNION ALL SELECT id, 'E', 'no_evidence' FROM d WHERE ev = 0 UNION ALL SELECT id, 'E', 'duplicate' FROM d WHERE first < id
UNION ALL SELECT id, 'E', 'name_taken' FROM d WHERE name IN (SELECT 'c-' || c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT id, 'W', 'path_exists' FROM d WHERE path IN (SELECT 'p' || l_orderkey FROM lineitem WHERE l_quantity > 45)
UNION ALL SELECT id, 'W', 'opened_unreadable' FROM d WHERE day IS NULL UNION ALL SELECT id, 'I', 'ready' FROM d WHERE ev >= 2 UNION ALL SELECT id, 'I', 'ageing' FROM d WHERE date_diff('day', day, DATE '1998-08-01') > 90 UNION ALL SELECT id, 'W', 'domain' FROM d WHERE domain NOT IN ('1-URGENT', '2-HIGH')
""")
def c13_candidates(spark, sf_dir):
    k = F.col("o_orderkey")
    o = t(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(F.when(k % 6 == 0, "C_").otherwise("c-"), "o_custkey").alias("name"), F.floor(F.col("o_totalprice") / 100000).alias("evidence"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("domain"), F.when(k % 4 != 0, F.concat(F.lit("p"), k)).alias("path"),
        F.when(k % 3 == 0, "").otherwise("clerk").alias("rationale"), F.lit("later").alias("graduation"), F.when(k % 11 == 0, F.lit(None)).when(k % 12 == 0, "soon").otherwise(F.to_date("o_orderdate").cast("string")).alias("opened_at"),
    )
    taken = t(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("c-"), "c_custkey").alias("name"))
    paths = t(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.concat(F.lit("p"), "l_orderkey").alias("path"))
    return C.candidate_findings(o, F.lit("1998-08-01").cast("date"), domains=["1-URGENT", "2-HIGH"], packages=taken, paths=paths)


@query(TERM_TABLE + ", h AS (SELECT DISTINCT term, doc_id FROM q JOIN g ON form = term) SELECT term, count(doc_id) AS docs FROM q LEFT JOIN h USING (term) GROUP BY 1")
def c14_index_findings(spark, sf_dir):
    return C.index_findings(benchmark_terms(spark, sf_dir), documents(spark, sf_dir), "doc_id", "text", "term")


@query("""
WITH p AS (SELECT p_partkey AS k, p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)
SELECT brand AS doc_id, r + 2 AS line_no, 'P' || k || CASE WHEN k % 5 = 0 THEN ' / Q' || k ELSE '' END AS cell FROM p WHERE k % 3 <> 0 AND (k % 2 = 0 OR k % 5 = 0) AND k % 7 <> 0
""")
def c14_free_rows(spark, sf_dir):
    """A table of parts for each brand; odd parts are registered, every fifth row names a second thing that isn't, every third is marked as withdrawn, every
    seventh has its name in another script."""
    k = F.col("p_partkey")
    name = F.when(k % 7 == 0, "部件").otherwise(F.concat(F.lit("`P"), k, F.lit("` (old)"), F.when(k % 5 == 0, F.concat(F.lit(" / Q"), k)).otherwise("")))
    row = F.concat(F.lit("| "), name, F.lit(" | "), F.when(k % 3 == 0, "withdrawn").otherwise("in use"), F.lit(" |"))
    rows = t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    text = F.array_join(F.concat(F.array(F.lit("| name | state |"), F.lit("|---|---|")), "rows"), "\n")
    names = t(spark, sf_dir, "part").filter("p_partkey % 2 = 1").select(F.concat(F.lit("p"), "p_partkey").alias("name"))
    found = C.free_rows(E.lines_of(rows.select("doc_id", text.alias("text")), "doc_id", "text"), names, "withdrawn")
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("cell", r" \(old\)", "").alias("cell"))


@query("""
SELECT doc_id, sha1('gate|' || source || '|' || sha1(text)) AS id FROM documents WHERE text IS NOT NULL AND sha1('gate|' || source || '|' || sha1(text)) NOT IN (SELECT sha1('gate|' || source || '|' || sha1(text)) FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0)
""")
def c15_fresh_findings(spark, sf_dir):
    f = documents(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.lit("gate").alias("gate"), F.col("source").alias("file"), F.col("text").alias("match"))
    base = C.fresh_findings(f.filter("doc_id % 2 = 0"), None).select("id")
    return C.fresh_findings(f, base).select("doc_id", "id")


@query("""
WITH f AS (SELECT event_id, event_type AS rule, CASE WHEN value > 400 THEN 'error' WHEN value > 100 THEN 'note' ELSE 'warn' END AS level, CASE WHEN event_id % 3 = 0 THEN 'regex-degraded' ELSE 'exact' END AS fidelity FROM events)
SELECT event_id, CASE WHEN rule = 'error' THEN 'error' WHEN fidelity = 'regex-degraded' THEN 'warn' WHEN rule = 'click' THEN 'error' WHEN level = 'note' THEN 'warn' ELSE level END AS outcome FROM f WHERE rule <> 'view'
""")
def p16_resolve_level(spark, sf_dir):
    f = t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("rule"), F.when(F.col("value") > 400, "error").when(F.col("value") > 100, "note").otherwise("warn").alias("level"), F.when(F.col("event_id") % 3 == 0, "regex-degraded").otherwise("exact").alias("fidelity"))
    config = spark.createDataFrame([("view", "off"), ("error", "required"), ("click", "error")], "rule string, setting string")
    return L.resolve_level(f, config).select("event_id", "outcome")


@query("SELECT source, count(*) FILTER (n_chars < 100) AS errors, count(*) FILTER (n_chars BETWEEN 100 AND 999) AS warnings, count(*) FILTER (n_chars > 999) AS notes, count(*) FILTER (n_chars < 1000) = 0 AS passed FROM documents GROUP BY 1")
def a23_issue_summary(spark, sf_dir):
    f = documents(spark, sf_dir).select("source", F.when(F.col("n_chars") < 100, "E").when(F.col("n_chars") < 1000, "W").otherwise("I").alias("level"))
    return L.issue_summary(f, strict=True)
