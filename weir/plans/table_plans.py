"""Relational queries: joins, aggregations, windows, set operations, availability and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.patterns import FORMS, flex_pattern
from ..operators import aggregates as A
from ..operators import extract as E
from ..operators import joins as J
from ..operators import ranking as R
from ..operators import sets as S
from ..operators.filters import restrict_to_changed
from ..operators.terms import match_term_table
from ..sources import io as IO
from .kit import Book, sql_list, t

book = Book()
query = book.query
QUERIES, ORACLES = book.queries, book.oracles

STOP = sql_list([*X.STOP_EN, *X.STOP_CJK])
TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(%s, '')), '[a-z0-9][a-z0-9_.+-]*'), lambda x: x NOT IN ({STOP}))"
BM25F = f"""
WITH f AS (SELECT doc_id, 'source' AS field, 3.0 AS boost, {TOKENS % "source"} AS k FROM documents
  UNION ALL SELECT doc_id, 'lang', 2.0, {TOKENS % "lang"} FROM documents UNION ALL SELECT doc_id, 'text', 1.0, {TOKENS % "text"} FROM documents),
a AS (SELECT field, count(*) AS n, coalesce(nullif(avg(len(k)), 0), 1) AS avl FROM f GROUP BY 1),
tok AS (SELECT doc_id, field, boost, len(k) AS len, unnest(k) AS token FROM f),
tf AS (SELECT doc_id, field, boost, len, token, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT token, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest({TOKENS % "text"}) AS token FROM benchmark),
w AS (SELECT doc_id, token, sum(tf * boost / (0.25 + 0.75 * len / avl)) AS w, max(CASE WHEN boost > 1 THEN 1 ELSE 0 END) AS boosted, first(n) AS n FROM tf JOIN a USING (field) WHERE token IN (SELECT token FROM q) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * w / (1.4 + w)) AS score, count(*) AS matched, sum(boosted) AS matched_boost FROM q JOIN w USING (token) JOIN df USING (token) GROUP BY 1, 2)
"""


def documents(spark, sf_dir):
    return t(spark, sf_dir, "documents")


def _bm25f(spark, sf_dir):
    fields = {"source": (F.col("source"), 3.0), "lang": (F.col("lang"), 2.0), "text": (F.col("text"), 1.0)}
    return R.bm25f(t(spark, sf_dir, "benchmark"), documents(spark, sf_dir), fields, "item_id", "text")


@query(BM25F + "SELECT item_id, doc_id, round(score, 4) AS score, matched, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 5")
def a2_bm25f(spark, sf_dir):
    # sums differ in the last digits from run to run, so ties are told by a rounded score
    best = R.top_k(_bm25f(spark, sf_dir).withColumn("near", F.round("score", 6)), ["qid"], "near", 5, ["doc"])
    return best.select(F.col("qid").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 4).alias("score"), "matched", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH k AS (SELECT doc_id, unnest({TOKENS % "text"}) AS token FROM documents) SELECT token, count(DISTINCT doc_id) AS df FROM k GROUP BY 1
""")
def a1_bm25f_stats(spark, sf_dir):
    df, _ = R.bm25f_stats(R.field_tokens(documents(spark, sf_dir), "doc_id", {"text": F.col("text")}))
    return df


@query(BM25F + "SELECT item_id, count(*) AS nominated, max(matched) AS most FROM (SELECT *, round(score / max(score) OVER (PARTITION BY item_id), 9) AS norm FROM s) WHERE norm >= 0.45 AND matched >= 1 AND matched_boost >= 0 GROUP BY 1")
def w2_nominate(spark, sf_dir):
    rows = R.nominate(_bm25f(spark, sf_dir).withColumn("score", F.round("score", 9)), floor=0.45, least=0).filter("matched >= 1")
    return rows.groupBy(F.col("qid").alias("item_id")).agg(F.count("*").alias("nominated"), F.max("matched").alias("most"))


PAIRS = "SELECT q.vec_id AS qid, d.vec_id AS doc, q.label AS qlabel, d.label AS dlabel, list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS score FROM embeddings q JOIN embeddings d ON q.vec_id % 100 = 0"


def _pairs(spark, sf_dir, k):
    e = t(spark, sf_dir, "embeddings")
    return R.score_pairs(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", "vec_id", "embedding", k)


@query(f"SELECT qid, doc, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM ({PAIRS})) WHERE rank <= 5")
def j1_score_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, 5).select("qid", "doc", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(CAST(embedding[1] AS DOUBLE), 6) DESC, vec_id) AS r FROM embeddings) WHERE r <= 3")
def w1_top_k(spark, sf_dir):
    rows = t(spark, sf_dir, "embeddings").select("label", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("s"))
    return R.top_k(rows, ["label"], "s", 3, ["vec_id"]).select("label", "vec_id")


TERMS = ["licence", "license", "version", "with", "there", "party", "wenn", "dass", "pour"]


@query("WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents) " + " UNION ALL ".join(f"SELECT '{x}' AS term, doc_id FROM d WHERE regexp_matches(s, '{flex_pattern(x)}')" for x in TERMS))
def j3_match_terms(spark, sf_dir):
    return J.match_terms(documents(spark, sf_dir), TERMS, "doc_id", "text").select("term", F.col("doc").alias("doc_id"))


_FORMS = ", ".join(f"CASE WHEN length(term) >= {least} AND regexp_matches(term, '(?:{ending})$') THEN left(term, length(term) - {cut}) || '{instead}' END" for ending, cut, instead, least in FORMS)
#: Words and pairs of words of the benchmark as terms, with their forms, and stretches of one and two runs of every document.
TERM_TABLE = rf"""
WITH w AS (SELECT string_split(lower(text), ' ') AS w FROM benchmark),
q AS (SELECT DISTINCT term FROM (SELECT unnest(w) AS term FROM w UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)) WHERE regexp_full_match(term, '[a-z0-9]+( [a-z0-9]+)?')),
f AS (SELECT DISTINCT term, unnest(list_filter([term, {_FORMS}], lambda x: x IS NOT NULL)) AS form FROM q),
k AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_-]+|[^a-z0-9_-]+') AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 2 * n - 2], '') AS form FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM k), (SELECT unnest([1, 2]) AS n) WHERE i + 2 * n - 2 <= len(t) AND regexp_matches(t[i], '^[a-z0-9_-]'))
"""


def benchmark_terms(spark, sf_dir):
    """(term): words and pairs of words of the benchmark."""
    w = t(spark, sf_dir, "benchmark").select(F.split(F.lower("text"), " ").alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    both = F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))
    return w.select(F.explode(both).alias("term")).filter(F.col("term").rlike(r"\A[a-z0-9]+( [a-z0-9]+)?\z")).distinct()


@query(TERM_TABLE + "SELECT DISTINCT term, doc_id FROM f JOIN g USING (form)")
def j3_match_term_table(spark, sf_dir):
    return match_term_table(documents(spark, sf_dir), benchmark_terms(spark, sf_dir), "doc_id", "text").select("term", F.col("doc").alias("doc_id"))


KEY = r"trim(regexp_replace(lower(%s), '[ \t\n\r\f\x0B]+', ' ', 'g'))"


@query(f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {KEY % 'text'} NOT IN (SELECT {KEY % 'text'} FROM benchmark WHERE text IS NOT NULL)")
def j4_fresh_only(spark, sf_dir):
    return J.fresh_only(documents(spark, sf_dir).filter("text IS NOT NULL"), "text", (t(spark, sf_dir, "benchmark"), "text")).select("doc_id")


@query("""
SELECT coalesce(a.doc_id, b.doc_id) AS id, CASE WHEN a.doc_id IS NULL THEN 'gone' WHEN b.doc_id IS NULL THEN CASE WHEN a.quality = 1 THEN 'new_pass' ELSE 'new_miss' END
  WHEN b.toxic = 0 AND a.quality = 0 THEN 'regression' WHEN b.toxic <> 0 AND a.quality = 1 THEN 'fixed' WHEN a.quality = 0 THEN 'known_miss' ELSE 'pass' END AS state
FROM (SELECT * FROM labels WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT * FROM labels WHERE doc_id % 7 <> 0) b ON a.doc_id = b.doc_id
""")
def j5_compare_baseline(spark, sf_dir):
    labels = t(spark, sf_dir, "labels")
    now = labels.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("pass"))
    return J.compare_baseline(now, labels.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), (F.col("toxic") == 0).alias("pass")))


@query("""
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'missing' WHEN a.c_custkey IS NULL THEN 'added' ELSE 'changed' END AS change
FROM (SELECT * FROM customer WHERE c_custkey % 6 <> 0) a FULL JOIN (SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 4 <> 0) b ON a.c_custkey = b.c_custkey
WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_acctbal IS DISTINCT FROM b.c_acctbal OR a.c_name IS DISTINCT FROM b.c_name
""")
def j6_snapshot_drift(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    now = c.filter("c_custkey % 4 <> 0").withColumn("c_acctbal", F.when(F.col("c_acctbal") < 0, 0.0).otherwise(F.col("c_acctbal")))
    return J.snapshot_drift(c.filter("c_custkey % 6 <> 0"), now, ["c_custkey"], ["c_name", "c_acctbal"])


@query("""
SELECT c_custkey AS k, 'uncovered' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT DISTINCT o_custkey, 'foreign' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
""")
def j7_coverage(spark, sf_dir):
    return J.coverage(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("""
WITH d AS (SELECT p_name || '-' || p_size % 7 AS name, list_sort(list(DISTINCT p_brand)) AS a FROM part GROUP BY 1)
SELECT p_partkey, CASE WHEN len(a) = 1 THEN a[1] END AS symbol, len(a) > 1 AS ambiguous, CASE WHEN len(a) > 1 THEN array_to_string(a[1:8], ',') END AS candidates FROM part JOIN d ON p_name || '-' || p_partkey % 9 = name
""")
def j8_resolve_mentions(spark, sf_dir):
    """Parts declare their brand under a name, and mention names of which some are declared once, some more than once, some never."""
    p = t(spark, sf_dir, "part")
    named = lambda n: F.concat("p_name", F.lit("-"), n)
    out = J.resolve_mentions(p.select("p_partkey", named(F.col("p_partkey") % 9).alias("name")), p.select(named(F.col("p_size") % 7).alias("name"), F.col("p_brand").alias("symbol")))
    return out.select("p_partkey", "symbol", "ambiguous", F.array_join("candidates", ",").alias("candidates"))


@query(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
r AS (SELECT page_id, target, array_to_string(list_filter(string_split(string_split(target, '#')[1], '/'), lambda x: x NOT IN ('', '.')), '/') AS p FROM l),
f AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark))
SELECT page_id, count(*) AS links, sum(CASE WHEN word IS NULL THEN 1 ELSE 0 END) AS dead FROM r LEFT JOIN f ON p = word GROUP BY 1
""")
def j9_resolve_links(spark, sf_dir):
    links = t(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target")).withColumn("src", F.lit(""))
    files = t(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("path")).distinct()
    return J.resolve_links(links, files).groupBy("page_id").agg(F.count("*").alias("links"), F.sum(F.col("dead").cast("long")).alias("dead"))


FLOWS = "SELECT user_id AS session, ts, event_id, event_type AS url, 'GET' AS method FROM events"


@query(f"""
WITH fl AS ({FLOWS}), ac AS (SELECT event_id AS action_id, user_id AS session, ts AS start_ts FROM events WHERE event_type = 'signup'),
g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 THEN 0 ELSE 1 END AS b FROM fl WINDOW w AS (PARTITION BY session ORDER BY ts)),
bu AS (SELECT *, sum(b) OVER (PARTITION BY session ORDER BY ts) AS burst FROM g),
nx AS (SELECT action_id, ac.session, start_ts, min(burst) AS burst FROM ac JOIN bu ON bu.session = ac.session AND bu.ts > ac.start_ts GROUP BY 1, 2, 3)
SELECT action_id, count(*) AS flows, min(event_id) AS first_flow FROM nx JOIN bu ON bu.session = nx.session AND bu.burst = nx.burst AND bu.ts > nx.start_ts WHERE url <> 'view' GROUP BY 1
""")
def j12_slice_windows(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    flows = e.select(F.col("user_id").alias("session"), "ts", "event_id", F.col("event_type").alias("url"), F.lit("GET").alias("method"))
    actions = e.filter("event_type = 'signup'").select(F.col("event_id").alias("action_id"), F.col("user_id").alias("session"), F.col("ts").alias("start_ts"))
    base = spark.createDataFrame([("view", "GET")], "url string, method string")
    return J.slice_windows(actions, flows, 21600, base).groupBy("action_id").agg(F.count("*").alias("flows"), F.min("event_id").alias("first_flow"))


TURNS = "SELECT conv_id, turn, role, CASE WHEN length(text) % 3 = 0 THEN substr(text, 1, 8) END AS label FROM conversations"


@query(f"""
WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS seg, row_number() OVER w AS pos FROM ({TURNS}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
h AS (SELECT *, min(pos) OVER (PARTITION BY conv_id, seg) AS head FROM t WHERE seg > 0),
p AS (SELECT conv_id, seg, min_by(label, pos) AS actual FROM h WHERE role <> 'user' AND label IS NOT NULL AND pos - head <= 2 GROUP BY 1, 2)
SELECT u.conv_id, u.turn, actual FROM h u LEFT JOIN p USING (conv_id, seg) WHERE u.role = 'user'
""")
def j13_forward_label(spark, sf_dir):
    turns = t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.length("text") % 3 == 0, F.substring("text", 1, 8)).alias("label"))
    return J.forward_label(turns, 2).select("conv_id", "turn", "actual")


SQUEEZE = r"left(regexp_replace(text, '[ \t\n\r\f\x0B]+', '', 'g'), 200)"


@query(f"""
WITH p AS (SELECT doc_id AS id, {SQUEEZE} AS k, n_chars AS score FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL), b AS (SELECT k, min_by(score, id) AS s2 FROM p GROUP BY 1)
SELECT doc_id AS id, coalesce(p.score, s2) AS score, CASE WHEN p.score IS NOT NULL THEN 'id' WHEN s2 IS NOT NULL THEN 'text' ELSE 'new' END AS reused
FROM (SELECT doc_id, {SQUEEZE} AS k FROM documents WHERE text IS NOT NULL) d LEFT JOIN p ON p.id = doc_id LEFT JOIN b ON b.k = d.k
""")
def j14_reuse_scores(spark, sf_dir):
    d = documents(spark, sf_dir).filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("score"))
    return J.reuse_scores(d.drop("score"), d.filter("id % 3 = 0")).select("id", "score", "reused")


@query(f"""
WITH r AS (SELECT qid, doc, dlabel, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM ({PAIRS})),
g AS (SELECT qid, list(doc ORDER BY rank) AS top FROM r WHERE rank <= 3 GROUP BY 1),
w AS (SELECT q.vec_id AS qid, list(d.vec_id) AS wanted, q.label = 0 AS oos FROM embeddings q JOIN embeddings d ON d.label = q.label WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, q.label)
SELECT qid AS id, CASE WHEN oos THEN NULL ELSE list_contains(wanted, top[1]) END AS top1_hit, CASE WHEN oos THEN NULL ELSE list_has_any(wanted, top) END AS hit3 FROM g JOIN w USING (qid)
""")
def j15_rescore(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    labels = e.select(F.col("vec_id").alias("doc"), F.col("label").alias("doc_label"))
    best = _pairs(spark, sf_dir, 3).select(F.col("qid").alias("id"), "doc", "rank").join(labels, "doc")
    ranked = best.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("top"))
    # of the rows of a query's label, those that matter are among its three best (and the query itself)
    same = best.join(e.select(F.col("vec_id").alias("id"), "label"), "id").groupBy("id", "label").agg(F.collect_list(F.when(F.col("doc_label") == F.col("label"), F.col("doc"))).alias("near"))
    wanted = same.select("id", F.array_union("near", F.array("id")).alias("wanted"), (F.col("label") == 0).alias("oos"))
    return J.rescore(ranked, wanted).select("id", "top1_hit", "hit3")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, l_orderkey + 1 AS parent FROM lineitem) WHERE parent NOT IN (SELECT l_orderkey FROM lineitem)")
def j17_dangling_parents(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") + 1).alias("parent"))
    return J.dangling_parents(li, "l_orderkey", "parent").select("l_orderkey", "l_linenumber")


@query("""
WITH a AS (SELECT c_custkey AS k, c_nationkey AS nation, c_acctbal AS bal FROM customer), b AS (SELECT s_suppkey AS k, s_nationkey AS nation, s_acctbal AS bal FROM supplier)
SELECT a.k, 'dangling' AS issue FROM a LEFT JOIN b USING (k) WHERE b.k IS NULL UNION ALL SELECT b.k, 'unregistered' FROM b LEFT JOIN a USING (k) WHERE a.k IS NULL
UNION ALL SELECT a.k, 'nation_differs' FROM a JOIN b USING (k) WHERE a.nation IS DISTINCT FROM b.nation UNION ALL SELECT a.k, 'bal_differs' FROM a JOIN b USING (k) WHERE a.bal IS DISTINCT FROM b.bal
""")
def j18_reconcile_index(spark, sf_dir):
    a = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))
    b = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    return J.reconcile_index(a, b, "k", ["nation", "bal"])


@query(r"""
WITH u AS (SELECT unit, list_last(string_split(unit, '/')) AS base FROM (SELECT DISTINCT unnest(['that', 'there', 'widget', 'licensed under the apache license', 'nicht', 'ring', 'gear', 'is', 'src/there.py', 'lib/license.txt', 'doc/it is/widgets.md', 'a/under the.x']) AS unit UNION SELECT 'lib/' || replace(p_name, ' ', '_') || '.txt' FROM part)),
f AS (SELECT unit, ' ' || regexp_replace(unnest([unit, base, CASE WHEN length(regexp_replace(base, '\.[^.]+$', '')) >= 6 THEN regexp_replace(base, '\.[^.]+$', '') ELSE unit END]), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' AS form FROM u),
d AS (SELECT ' ' || regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' AS s FROM documents),
h AS (SELECT unit, bool_or(contains(s, form)) AS hit FROM f, d GROUP BY 1)
SELECT unit, CASE WHEN unit = 'gear' THEN 'exemption_without_reason' WHEN unit = 'that' AND hit THEN 'stale_exemption' WHEN unit IN ('that', 'ring') THEN 'exempt' WHEN hit THEN 'covered' ELSE 'uncovered' END AS status FROM h
""")
def j20_mention_coverage(spark, sf_dir):
    units = spark.createDataFrame([(u,) for u in ("that", "there", "widget", "licensed under the apache license", "nicht", "ring", "gear", "is", "src/there.py", "lib/license.txt", "doc/it is/widgets.md", "a/under the.x")], "unit string").union(t(spark, sf_dir, "part").select(F.concat(F.lit("lib/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".txt"))).distinct())
    exempt = spark.createDataFrame([("that", "common"), ("ring", "a part"), ("gear", " ")], "unit string, reason string")
    return J.mention_coverage(units, documents(spark, sf_dir), exempt)


@query(r"""
WITH o AS (SELECT DISTINCT regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages), r AS (SELECT path FROM o WHERE path LIKE '%.html'),
p AS (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS path FROM (SELECT path, unnest(range(1, greatest(len(string_split(path, '/')) , 2))) AS n FROM r))
SELECT path FROM o WHERE path NOT IN (SELECT path FROM r) AND path NOT IN (SELECT path FROM p) AND NOT regexp_matches(list_last(string_split(path, '/')), '^[._]')
""")
def j21_orphans(spark, sf_dir):
    o = t(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return J.orphans(o, o.filter("path LIKE '%.html'"))


@query("SELECT lang, count(*) FILTER (quality = 1) AS passed, count(*) AS total, round(count(*) FILTER (quality = 1) / count(*), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def a3_pass_rate(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "lang").join(t(spark, sf_dir, "labels"), "doc_id").withColumn("pass", F.col("quality") == 1)
    return A.pass_rate(rows, "lang").withColumn("rate", F.round("rate", 6))


FACETS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]


@query("SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS r FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY {c}" for c in FACETS) + ")) WHERE r <= 20")
def a4_facet_counts(spark, sf_dir):
    return A.facet_counts(t(spark, sf_dir, "lineitem"), FACETS).select("facet", "value", "n")


ORDER_FLOWS = "SELECT o_orderkey, cn.n_regionkey AS src, sn.n_regionkey AS dst, o_orderstatus AS kind FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey"


def order_flows(spark, sf_dir):
    o, c, li, s, n = (t(spark, sf_dir, x) for x in ("orders", "customer", "lineitem", "supplier", "nation"))
    src = o.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("kind")).join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("src_domain")), "c_nationkey")
    dst = li.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(s.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("dst_domain")), "s_nationkey")
    return src.join(dst, "o_orderkey").select("o_orderkey", F.col("src_domain").cast("string").alias("src_domain"), F.col("dst_domain").cast("string").alias("dst_domain"), "kind")


@query(f"""
WITH e AS (SELECT CAST(src AS VARCHAR) AS a, CAST(dst AS VARCHAR) AS b FROM ({ORDER_FLOWS})), f AS (SELECT CAST(n_regionkey AS VARCHAR) AS domain, c_custkey, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT domain, files, degraded, exempt, coalesce(o, 0) AS edges_out, coalesce(i, 0) AS edges_in FROM (SELECT domain, count(DISTINCT c_custkey) AS files, count(*) FILTER (c_acctbal < 0) AS degraded, count(*) FILTER (c_custkey % 10 = 0) AS exempt FROM f GROUP BY 1)
LEFT JOIN (SELECT a AS domain, count(*) AS o FROM e GROUP BY 1) USING (domain) LEFT JOIN (SELECT b AS domain, count(*) AS i FROM e GROUP BY 1) USING (domain)
""")
def a5_namespace_rollup(spark, sf_dir):
    c = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    files = c.select(F.col("c_custkey").alias("file"), F.col("n_regionkey").cast("string").alias("domain"), F.when(F.col("c_acctbal") < 0, "regex-degraded").otherwise("exact").alias("fidelity"))
    return A.namespace_rollup(files, order_flows(spark, sf_dir), files.filter("file % 10 = 0").select("file"))


@query(f"""
SELECT CAST(src AS VARCHAR) AS src, CASE WHEN dst = 0 THEN 'external' WHEN dst = 1 THEN '__other__' ELSE CAST(dst AS VARCHAR) END AS dst, count(*) AS n, count(*) FILTER (kind = 'F') AS kind_f FROM ({ORDER_FLOWS}) GROUP BY 1, 2
""")
def a6_edge_matrix(spark, sf_dir):
    e = order_flows(spark, sf_dir).withColumns({"dead": F.lit(False), "external": F.col("dst_domain") == "0", "dst_domain": F.when(F.col("dst_domain") != "1", F.col("dst_domain"))})
    return A.edge_matrix(e).select("src", "dst", "n", F.coalesce(F.col("kinds")["F"], F.lit(0)).cast("long").alias("kind_f"))


@query("SELECT source AS unit, count(*) AS facts, count(*) FILTER (n_chars < 200) AS degraded, round(count(*) FILTER (n_chars < 200) / count(*), 6) AS rate FROM documents GROUP BY 1 HAVING count(*) FILTER (n_chars < 200) > 0")
def a7_degraded_rate(spark, sf_dir):
    facts = documents(spark, sf_dir).select(F.col("source").alias("unit"), F.when(F.col("n_chars") < 200, "regex-degraded").otherwise("exact").alias("fidelity"))
    return A.degraded_rate(facts).withColumn("rate", F.round("rate", 6))


@query("SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS sources, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS depends_on, count(DISTINCT l_suppkey) AS n_sources FROM lineitem GROUP BY 1")
def a8_merge_components(spark, sf_dir):
    m = A.merge_components(t(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag")
    return m.select("l_partkey", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"), F.array_join("depends_on", ",").alias("depends_on"), "n_sources")


@query("SELECT l_partkey, arg_min(h, (l_orderkey * 100 + l_linenumber) * 1000000 + l_suppkey) AS h FROM (SELECT *, CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS BIGINT) END AS h FROM lineitem) GROUP BY 1")
def a9_components(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("long")).alias("h"), ((F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1000000 + F.col("l_suppkey")).alias("ord"))
    return A.components(li, "l_partkey", "h", "ord")


LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]


@query(f"SELECT severity, rank, coalesce(n, 0) AS n FROM (SELECT unnest([{sql_list(LEVELS)}]) AS severity, unnest(range(0, 6)) AS rank) LEFT JOIN (SELECT o_orderpriority AS severity, count(*) AS n FROM orders GROUP BY 1) USING (severity)")
def a10_severity_summary(spark, sf_dir):
    out = A.severity_summary(t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("severity")), LEVELS)
    return out.select("severity", F.col("rank").cast("long").alias("rank"), "n")


@query("SELECT count(*) AS n, true AS same FROM orders")
def a12_table_fingerprint(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    a, b = A.table_fingerprint(o), A.table_fingerprint(o.orderBy("o_totalprice").select(*reversed(o.columns)))
    return a.join(b.select(F.col("n").alias("n2"), F.col("xor").alias("x2"), F.col("sum").alias("s2"))).select("n", ((F.col("n") == F.col("n2")) & (F.col("xor") == F.col("x2")) & (F.col("sum") == F.col("s2"))).alias("same"))


@query(r"""
WITH k AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[a-z]+[.][0-9]{2}')) AS token FROM documents), b AS (SELECT regexp_extract(token, '^([a-z]+)', 1) AS prefix, token, count(*) AS hits FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY token) AS n FROM b)
SELECT prefix, count(*) AS tokens, sum(hits) AS hits, string_agg(token, ',' ORDER BY token) FILTER (n <= 5) AS sample FROM r GROUP BY 1 HAVING count(*) >= 2
""")
def a13_token_families(spark, sf_dir):
    out = A.token_families(documents(spark, sf_dir), "doc_id", "text", pattern="([a-z]+[.][0-9]{2})", prefix="^([a-z]+)", stop=["zzz"])
    return out.select("prefix", "tokens", "hits", F.array_join("sample", ",").alias("sample"))


@query("SELECT md5(text) AS id, count(DISTINCT doc_id) AS sites FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def a14_collisions(spark, sf_dir):
    d = documents(spark, sf_dir).filter("text IS NOT NULL").select(F.md5(F.col("text").cast("binary")).alias("id"), "doc_id")
    return A.collisions(d, "id", "doc_id")


@query("""
WITH d AS (SELECT DISTINCT CAST(c_custkey % 4 AS VARCHAR) AS ns, c_custkey AS id FROM customer WHERE c_custkey % 9 <> 0), r AS (SELECT CAST(o_custkey % 4 AS VARCHAR) AS ns, o_custkey AS id, o_orderpriority AS file FROM orders),
u AS (SELECT ns, id, count(*) AS n FROM r GROUP BY 1, 2)
SELECT coalesce(d.ns, u.ns) AS ns, count(d.id) AS defs, coalesce(sum(n), 0) AS refs, coalesce(sum(n) FILTER (d.id IS NULL), 0) AS dangling, count(*) FILTER (n IS NULL) AS dead, max((SELECT count(DISTINCT file) FROM r WHERE r.ns = coalesce(d.ns, u.ns))) AS files
FROM d FULL JOIN u ON d.ns = u.ns AND d.id = u.id GROUP BY 1
""")
def a15_ref_stats(spark, sf_dir):
    d = t(spark, sf_dir, "customer").filter("c_custkey % 9 <> 0").select((F.col("c_custkey") % 4).cast("string").alias("ns"), F.col("c_custkey").alias("id"))
    r = t(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).cast("string").alias("ns"), F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("file"))
    return A.ref_stats(d, r).select("ns", "defs", "refs", "dangling", "dead", "files")


@query("SELECT p_partkey AS id, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS sites, coalesce(max(n), 0) AS refs, coalesce(max(n), 0) = 0 AS dead FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1")
def a16_label_index(spark, sf_dir):
    d = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("site"))
    out = A.label_index(d, t(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("id")))
    return out.select("id", F.array_join("sites", ",").alias("sites"), "refs", "dead")


@query("""
WITH e AS (SELECT event_type AS r, user_id % 7 AS c FROM events WHERE NOT (event_type = 'view' AND user_id % 7 = 3)), n AS (SELECT r, c, count(*) AS n FROM e GROUP BY 1, 2),
m AS (SELECT r, c FROM (SELECT DISTINCT event_type AS r FROM events) CROSS JOIN (SELECT DISTINCT user_id % 7 AS c FROM events))
SELECT r, c, coalesce(n, 0) AS n, CASE WHEN r = 'click' AND c = 2 AND coalesce(n, 0) > 0 THEN 'contradiction' WHEN r = 'click' AND c = 2 THEN 'declared_zero' WHEN n > 0 THEN 'covered' ELSE 'empty' END AS status FROM m LEFT JOIN n USING (r, c)
""")
def a17_coverage_matrix(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("r"), (F.col("user_id") % 7).alias("c"))
    zero = spark.createDataFrame([("click", 2)], "r string, c long")
    return A.coverage_matrix(e.filter("NOT (r = 'view' AND c = 3)"), e, e, zero, "r", "c")


EVAL = f"""WITH r AS (SELECT qid, qlabel, dlabel, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS k FROM ({PAIRS}) WHERE qid <> doc),
s AS (SELECT qid, qlabel = 0 AS oos, max(CASE WHEN k = 1 THEN score END) AS top1_score, bool_or(k = 1 AND dlabel = qlabel) AS top1_hit, bool_or(dlabel = qlabel) AS hit3, count(*) FILTER (score >= 0.3) AS n_picked, qid % 17 AS ms FROM r WHERE k <= 3 GROUP BY qid, qlabel)
"""


def eval_rows(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    lab = e.select(F.col("vec_id").alias("doc"), F.col("label").alias("dlabel"))
    best = R.top_k(_pairs(spark, sf_dir, 4).drop("rank").filter("qid <> doc"), ["qid"], "score", 3, ["doc"]).join(lab, "doc").join(lab.select(F.col("doc").alias("qid"), F.col("dlabel").alias("qlabel")), "qid").withColumn("score", F.round("score", 6))
    same = F.col("dlabel") == F.col("qlabel")
    rows = best.groupBy("qid", (F.col("qlabel") == 0).alias("oos")).agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1_score"), F.bool_or((F.col("rank") == 1) & same).alias("top1_hit"), F.bool_or(same).alias("hit3"), F.count_if(F.col("score") >= 0.3).alias("n_picked"))
    return rows.withColumns({"ms": F.col("qid") % 17, "hit_any": F.col("hit3"), "abstain_ok": F.when(F.col("oos"), F.col("top1_score") < 0.5), "band_hit": F.col("top1_score").between(0.2, 0.9)})


@query(EVAL + """, p AS (SELECT *, row_number() OVER (ORDER BY ms) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT count(*) FILTER (NOT oos) AS in_scope, count(*) FILTER (oos) AS out_of_scope, count(*) FILTER (NOT oos AND top1_hit) AS top1, count(*) FILTER (NOT oos AND hit3) AS top3, count(*) FILTER (oos AND top1_score < 0.5) AS abstain_ok,
  round(avg(top1_score) FILTER (NOT oos), 5) AS mean_in, round(avg(n_picked), 5) AS mean_picked, count(*) FILTER (top1_score BETWEEN 0.2 AND 0.9) AS band_hits, max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.5) AS BIGINT)) THEN ms END) AS p50, max(CASE WHEN i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) THEN ms END) AS p95 FROM p""")
def a18_eval_summary(spark, sf_dir):
    out = A.eval_summary(eval_rows(spark, sf_dir))
    return out.select("in_scope", "out_of_scope", "top1", "top3", "abstain_ok", F.round("mean_in", 5).alias("mean_in"), F.round("mean_picked", 5).alias("mean_picked"), "band_hits", "p50", "p95")


@query(EVAL + "SELECT CAST(qid % 3 AS VARCHAR) AS tier, count(*) AS n, count(*) FILTER (top1_hit) AS emb, count(*) FILTER (hit3) AS kw, count(*) FILTER (top1_hit OR hit3) AS either, count(*) FILTER (top1_hit AND NOT hit3) AS emb_only, count(*) FILTER (hit3 AND NOT top1_hit) AS kw_only, round(max(top1_score), 5) AS max_score, round(quantile_cont(top1_score, 0.5), 5) AS median_score, round(min(top1_score), 5) AS min_score FROM s GROUP BY 1")
def a19_recall_report(spark, sf_dir):
    rows = eval_rows(spark, sf_dir).select((F.col("qid") % 3).cast("string").alias("tier"), F.col("top1_hit").alias("emb_hit"), F.col("hit3").alias("kw_hit"), "top1_score")
    return A.recall_report(rows).withColumns({c: F.round(c, 5) for c in ("max_score", "median_score", "min_score")})


@query(EVAL + """, p AS (SELECT oos, top1_score AS s, row_number() OVER (PARTITION BY oos ORDER BY top1_score) - 1 AS i, count(*) OVER (PARTITION BY oos) AS n FROM (SELECT qid % 2 = 0 AS oos, top1_score FROM (SELECT qid // 100 AS qid, top1_score FROM s)))
SELECT round(max(s) FILTER (oos), 5) AS oos_max, round(max(s) FILTER (oos AND i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))), 5) AS oos_p95, round(max(s) FILTER (NOT oos AND i = least(n - 1, CAST(floor(n * 0.05) AS BIGINT))), 5) AS in_p05, round(avg(s) FILTER (NOT oos), 5) AS in_mean FROM p""")
def a20_separability(spark, sf_dir):
    rows = eval_rows(spark, sf_dir).withColumn("oos", F.expr("(qid div 100) % 2 = 0"))
    return A.separability(rows).select(*(F.round(c, 5).alias(c) for c in ("oos_max", "oos_p95", "in_p05", "in_mean")))


@query("SELECT l_returnflag, l_linestatus, l_extendedprice AS p FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem) WHERE i = least(n - 1, CAST(floor(n * 0.5) AS BIGINT))")
def a21_rank_percentile(spark, sf_dir):
    return R.rank_percentile(t(spark, sf_dir, "lineitem"), "l_extendedprice", 0.5, ["l_returnflag", "l_linestatus"])


@query("SELECT l_extendedprice AS p FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem) WHERE i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))")
def a21_rank_percentile_all(spark, sf_dir):
    return R.rank_percentile(t(spark, sf_dir, "lineitem"), "l_extendedprice", 0.95)


CORPUS = """
SELECT count(*) FILTER (source <> 'src0') AS files, round(count(*) FILTER (source <> 'src0' AND n_chars > 100) / greatest(count(*) FILTER (source <> 'src0'), 1), 6) AS parse_rate, round(sum(len(string_split(text, ' '))) * 1000.0 / sum(len(string_split(text, chr(10)))), 4) AS edges_per_kloc,
  count(*) FILTER (NOT regexp_matches(text, '^[A-Za-z0-9_.$/-]+$')) AS malformed FROM documents WHERE text IS NOT NULL
"""


@query(f"SELECT *, 'loose' AS gate, parse_rate >= 0.1 AND malformed <= 1e18 AS passed FROM ({CORPUS}) UNION ALL SELECT *, 'tight', parse_rate >= 0.1 AND malformed <= 5 FROM ({CORPUS})")
def a24_corpus_metrics(spark, sf_dir):
    d = documents(spark, sf_dir).filter("text IS NOT NULL")
    files = d.select((F.col("n_chars") > 100).alias("parsed"), (F.col("source") == "src0").alias("fixture"), F.size(F.split("text", " ")).alias("edges"), F.size(F.split("text", "\n")).alias("lines"), F.col("text").alias("name"))
    out = None
    for gate, limits in (("loose", {"parse_rate": 0.1}), ("tight", {"parse_rate": 0.1, "malformed": 5})):
        row = A.corpus_metrics(files, limits).select("files", F.round("parse_rate", 6).alias("parse_rate"), F.round("edges_per_kloc", 4).alias("edges_per_kloc"), "malformed", F.lit(gate).alias("gate"), "passed")
        out = row if out is None else out.unionByName(row)
    return out


@query(r"""
WITH f AS (SELECT regexp_extract(url, '://([^?#]*)', 1) AS path, url LIKE '%.html%' AS declares FROM pages)
SELECT string_split(path, '/')[1] AS head, count(*) AS files, count(*) FILTER (declares) AS declared, count(*) FILTER (path NOT LIKE '%/en/%') AS no_inbound, count(*) FILTER (declares) >= 0.8 * count(*) AS ignored FROM f GROUP BY 1
""")
def a26_topology_profile(spark, sf_dir):
    f = t(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"), F.col("url").contains(".html").alias("declares"))
    return A.topology_profile(f, f.filter(F.col("path").contains("/en/")).select(F.col("path").alias("dst")))


@query("SELECT 'layer' AS facet, CASE WHEN p_size > 40 THEN 'undeclared' ELSE p_type END AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'domain', p_brand, count(*) FROM part GROUP BY 2")
def a27_registry_stats(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.when(F.col("p_size") <= 40, F.col("p_type")).otherwise(" ").alias("layer"), "p_brand")
    return A.registry_stats(p, "layer", "p_brand")


@query("SELECT count(*) AS candidates, count(*) FILTER (o_totalprice >= 200000) AS ready, date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '2002-01-01') AS oldest_days FROM orders")
def a27_candidate_stats(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 100000).alias("evidence"), F.col("o_orderdate").alias("opened_at"))
    return A.candidate_stats(o, F.lit("2002-01-01").cast("date")).withColumn("oldest_days", F.col("oldest_days").cast("long"))


SERIES = "SELECT unnest(['view', 'click', 'error', 'signup', 'purchase', 'never']) AS series"


@query(f"""
WITH k AS (SELECT event_type AS series, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), a AS (SELECT series, max(value) FILTER (k = 1) AS latest, max(value) FILTER (k > 1) AS prev_max, count(*) AS points FROM k WHERE k <= 8 GROUP BY 1)
SELECT series, CASE WHEN points IS NULL THEN 'absence' WHEN points = 1 THEN 'baseline' WHEN latest > prev_max THEN 'new-high' ELSE 'flat' END AS status, latest, prev_max, coalesce(points, 0) AS points FROM ({SERIES}) LEFT JOIN a USING (series)
""")
def w3_new_high(spark, sf_dir):
    points = t(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "ts", F.col("event_id").alias("seq"), "value")
    listed = spark.createDataFrame([(s,) for s in ("view", "click", "error", "signup", "purchase", "never")], "series string")
    return R.new_high(points, listed, 8)


@query(f"SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL AND {KEY % 'text'} <> '' GROUP BY {KEY % 'text'}")
def w4_dedupe_first(spark, sf_dir):
    return R.dedupe_first(documents(spark, sf_dir).select("doc_id", "text"), X.norm_key(F.col("text")), ["doc_id"]).select("doc_id")


@query("SELECT doc_id, 'r-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS id FROM (SELECT doc_id, 120 + row_number() OVER (ORDER BY doc_id) AS n FROM documents)")
def w5_assign_ids(spark, sf_dir):
    existing = spark.createDataFrame([("r-0007",), ("r-0120",), ("x",)], "id string")
    new = documents(spark, sf_dir).select("doc_id", F.lit("").alias("id"))
    return R.assign_ids(new, existing, "id", "r-", 4, ["doc_id"]).select("doc_id", "id")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS first FROM conversations WHERE role = 'user'")
def w6_first_in_session(spark, sf_dir):
    return R.first_in_group(t(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn"), ["conv_id"], ["turn"])


LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line_no FROM documents"


@query(rf"""
WITH m AS (SELECT doc_id, line_no, line, CASE WHEN line_no % 5 = 0 THEN '```' ELSE line END AS s FROM ({LINES})), w AS (SELECT *, sum(CASE WHEN regexp_matches(s, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS o FROM m)
SELECT doc_id, count(*) AS kept, sum(line_no) AS places FROM w WHERE o % 2 = 0 AND NOT regexp_matches(s, '^\s*(```|~~~)') GROUP BY 1
""")
def w7_mask_fences(spark, sf_dir):
    # every fifth line is made a fence, as the texts have none
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    d = documents(spark, sf_dir).select("doc_id", F.array_join(F.transform(lines, lambda line, i: F.when(i % 5 == 4, "```").otherwise(line)), "\n").alias("text"))
    return R.mask_fences(E.lines_of(d, "doc_id", "text", fences=True)).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum("line_no").alias("places"))


@query(rf"""
WITH m AS (SELECT doc_id, line_no, nullif(regexp_extract(line, '^([A-E])[a-z]+', 1), '') AS h, regexp_extract(line, '^([F-Z])[a-z]+', 1) AS item FROM ({LINES}))
SELECT doc_id, line_no, section, item FROM (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM m) WHERE item <> '' AND section IS NOT NULL
""")
def w8_section_items(spark, sf_dir):
    out = R.section_items(E.lines_of(documents(spark, sf_dir), "doc_id", "text"), "^([A-E])[a-z]+", "^([F-Z])[a-z]+")
    return out.withColumn("line_no", F.col("line_no").cast("long"))


@query("""
WITH g AS (SELECT user_id AS session, ts, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) AS gap FROM events)
SELECT session, epoch_us(min(ts)) AS quiet_us FROM g WHERE gap IS NULL OR gap >= 86400000000 GROUP BY 1
""")
def w9_quiet_point(spark, sf_dir):
    q = R.quiet_point(t(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts"), 86400)
    return q.select("session", F.unix_micros(F.col("quiet_at").cast("timestamp")).alias("quiet_us"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def w10_latest(spark, sf_dir):
    return R.latest(t(spark, sf_dir, "events"), 50, ["ts", "event_id"]).select("event_id")


@query("SELECT o_orderkey AS id, date_diff('day', DATE '1998-08-01', CAST(o_orderdate AS DATE)) AS days, o_orderstatus = 'P' AND date_diff('day', DATE '1998-08-01', CAST(o_orderdate AS DATE)) <= 0 AS overdue FROM orders")
def w11_review_queue(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").alias("review_after"))
    return R.review_queue(o, F.lit("1998-08-01").cast("date")).select("id", F.col("days").cast("long").alias("days"), "overdue")


@query("""
WITH h AS (SELECT 'w' AS gate, source AS file, doc_id AS line, lang AS match FROM documents)
SELECT gate, file, line, match, CAST(NULL AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY gate, file ORDER BY line, match) AS k FROM h) WHERE k <= 5
UNION ALL SELECT gate, file, 0, NULL, count(*) FROM h GROUP BY 1, 2 HAVING count(*) > 5
""")
def w12_cap_hits(spark, sf_dir):
    h = documents(spark, sf_dir).select(F.lit("w").alias("gate"), F.col("source").alias("file"), F.col("doc_id").alias("line"), F.col("lang").alias("match"))
    return R.cap_hits(h, 5)


@query("SELECT source AS file, doc_id AS line, lang AS rule, CAST(n_chars AS VARCHAR) AS unit FROM documents")
def w13_order_findings(spark, sf_dir):
    return R.order_findings(documents(spark, sf_dir).select(F.col("source").alias("file"), F.col("doc_id").alias("line"), F.col("lang").alias("rule"), F.col("n_chars").cast("string").alias("unit")))


@query("""
WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 10), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 40)
SELECT *, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""")
def u1_fact_diff(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return S.fact_diff(li.filter("l_quantity > 10"), li.filter("l_quantity < 40"), ["l_orderkey", "l_partkey"])


@query("""
WITH a AS (SELECT doc_id // 2 AS k, md5(text) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id // 2 AS k, md5(text) AS h FROM documents WHERE doc_id % 2 = 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.h IS DISTINCT FROM b.h
""")
def u2_version_diff(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("k", F.expr("doc_id div 2"))
    return S.version_diff(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "k", "text")


@query("""
SELECT c_custkey AS k, 'missing' AS issue FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_custkey % 3 <> 0
UNION ALL SELECT DISTINCT o_custkey, 'undeclared' FROM orders WHERE o_totalprice > 300000 AND o_custkey NOT IN (SELECT c_custkey FROM customer)
""")
def u3_parity(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return S.parity(c, t(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k")), "k", optional=c.filter("k % 3 = 0"))


@query("""
WITH a AS (SELECT l_orderkey, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS x, list(DISTINCT l_linestatus ORDER BY l_linestatus) AS y FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_concat(x, list_filter(y, lambda v: NOT list_contains(x, v))), ',') AS u FROM a
""")
def u4_ordered_union(spark, sf_dir):
    a = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("x"), F.array_sort(F.collect_set("l_linestatus")).alias("y"))
    return a.select("l_orderkey", F.array_join(S.ordered_union(F.col("x"), F.col("y")), ",").alias("u"))


@query("SELECT prefix, 'unregistered' AS issue FROM (SELECT DISTINCT left(p_name, 3) AS prefix FROM part) WHERE prefix NOT IN (SELECT DISTINCT left(lower(c_mktsegment), 3) FROM customer) UNION ALL SELECT prefix, 'unmentioned' FROM (SELECT DISTINCT left(lower(c_mktsegment), 3) AS prefix FROM customer) WHERE prefix NOT IN (SELECT left(p_name, 3) FROM part)")
def u5_interlock(spark, sf_dir):
    a = t(spark, sf_dir, "part").select(F.left("p_name", F.lit(3)).alias("prefix"))
    return S.interlock(a, t(spark, sf_dir, "customer").select(F.left(F.lower("c_mktsegment"), F.lit(3)).alias("prefix")))


@query("SELECT l_returnflag, l_linestatus, count(*) FILTER (l_quantity > 20) - count(*) FILTER (l_quantity <= 20) AS surplus FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (l_quantity > 20) <> count(*) FILTER (l_quantity <= 20)")
def u6_same_rows(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return S.row_differences(li.filter("l_quantity > 20").select("l_returnflag", "l_linestatus"), li.filter("l_quantity <= 20").select("l_returnflag", "l_linestatus"))


@query("SELECT 'gone' AS key, 'removed' AS change, 'E' AS level UNION ALL SELECT DISTINCT 'k', 'added', 'I' FROM events")
def u7_key_drift(spark, sf_dir):
    return S.key_drift(t(spark, sf_dir, "events"), spark.createDataFrame([("gone",)], "key string"))


@query("SELECT p_partkey AS name, CASE WHEN n IS NULL THEN 'unregistered' WHEN p_partkey % 5 = 0 THEN 'disabled' WHEN n < 28 THEN 'missing' WHEN q > 25.5 THEN 'invalid' ELSE 'ready' END AS state FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def s7_availability(spark, sf_dir):
    u = t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("name")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"))
    units = u.select("name", (F.col("name") % 5 != 0).alias("enabled"), (F.col("n") >= 28).alias("present"), (F.col("q") <= 25.5).alias("valid"))
    return IO.availability(units, t(spark, sf_dir, "part").select(F.col("p_partkey").alias("name")))


@query("SELECT conv_id, string_agg(role || ':' || length(text), ';' ORDER BY turn) AS flow, count(*) AS turns FROM conversations GROUP BY 1")
def s5_transcripts(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    flow = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.length("text")).alias("s"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(flow, lambda x: x["s"]), ";").alias("flow"), F.count("*").alias("turns"))


@query("WITH c AS (SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_quantity > 49) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT node FROM c) OR l_suppkey IN (SELECT node FROM c)")
def p13_restrict_to_changed(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    e = li.withColumn("edge_id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    out = restrict_to_changed(e, li.filter("l_quantity > 49").select(F.col("l_partkey").alias("node")), src="l_partkey", dst="l_suppkey")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


WS_PARTS = """
WITH m AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS TIMESTAMP), event_type, props) - 1 AS place FROM events)
"""


@query(WS_PARTS + "SELECT user_id AS session, place // 20 AS part_no, string_agg(event_type, '>' ORDER BY place) AS flow FROM m GROUP BY 1, 2")
def t8_ws_sessions(spark, sf_dir):
    from ..streaming.ledgers import ws_sessions

    m = t(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("direction"), "props")
    return ws_sessions(m, text="props", most=20).select("session", "part_no", F.array_join(F.transform("messages", lambda x: x["direction"]), ">").alias("flow"))
