"""Text queries: tokens, markup, terms, keys, patterns, indicators, HTML, hygiene."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import extract as E
from ..operators import filters as L
from .kit import Book, sql_list, t

book = Book()
query = book.query
QUERIES, ORACLES = book.queries, book.oracles

STOP = sql_list([*X.STOP_EN, *X.STOP_CJK])
TEXTS_A_TASK = 10_000  # texts made from short rows that a task searches


def docs(spark, sf_dir):
    return t(spark, sf_dir, "documents")


@query(f"""
SELECT doc_id, len(k) AS n_tokens, len(list_distinct(k)) AS n_distinct, md5(array_to_string(k, ' ')) AS digest
FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_.+-]*'), lambda x: x NOT IN ({STOP})) AS k FROM documents)
""")
def x1_lex_tokens(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", X.lex_tokens(F.col("text")).alias("k"))
    return rows.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.size(F.array_distinct("k")).cast("long").alias("n_distinct"), F.md5(F.array_join("k", " ").cast("binary")).alias("digest"))


@query(r"""
SELECT doc_id, length(s) AS n, md5(s) AS digest FROM (
  SELECT doc_id, regexp_replace(regexp_replace(lower(trim(coalesce(text, ''))), '(?s)```.*?(?:```|\z)|~~~.*?(?:~~~|\z)', '', 'g'), '(?m)^\s*>.*$', '', 'g') AS s FROM documents)
""")
def x2_strip_markup(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.strip_markup(F.col("text")).alias("s")).select("doc_id", F.length("s").alias("n"), F.md5(F.col("s").cast("binary")).alias("digest"))


@query(r"""
SELECT doc_id, len(c) AS n_clauses, len(list_filter(c, lambda x: regexp_matches(x, '(^|[^a-z0-9_])(?:do not|don''t|without|exclude|not using)($|[^a-z0-9_])'))) AS n_negated
FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(lower(coalesce(text, '')), '(^|[^a-z0-9_])but($|[^a-z0-9_])', '\1' || chr(10) || '\2', 'g'), '(^|[^a-z0-9_])but($|[^a-z0-9_])', '\1' || chr(10) || '\2', 'g'), '[，,。；;' || chr(10) || '!?？！]|但是|而是') AS c FROM documents)
""")
def x3_active_text(spark, sf_dir):
    low = docs(spark, sf_dir).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("s"))
    rows = low.select("doc_id", X.clauses(F.col("s"), True).alias("negated"), X.clauses(F.col("s"), False).alias("active"))
    return rows.select("doc_id", (F.size("negated") + F.size("active")).cast("long").alias("n_clauses"), F.size("negated").cast("long").alias("n_negated"))


TERMS = ["licence", "license", "release", "version", "apache", "with", "there", "that", "party"]


def _flex_sql(term: str) -> str:
    return P.flex_pattern(term).replace("'", "''")


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(lower(coalesce(text, '')), '{_flex_sql(x)}') AS has_{x}" for x in TERMS) + " FROM documents")
def x4_flex_terms(spark, sf_dir):
    low = docs(spark, sf_dir).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    looked = low.withColumn("runs", P.runs_of(F.col("low"), TERMS))  # a text is cut once for all terms
    return looked.select("doc_id", *(P.holds(F.col("low"), F.col("runs"), x).alias(f"has_{x}") for x in TERMS))


def _any_sql(terms) -> str:
    return " OR ".join(f"regexp_matches(s, '{_flex_sql(x)}')" for x in terms)


@query(f"""
SELECT conv_id, turn, CASE WHEN regexp_matches(s, '(^|[^a-z0-9_])(?:read[- ]only|do not (?:edit|modify|implement|execute)|don''t (?:edit|modify|implement|execute))($|[^a-z0-9_])') OR {_any_sql(["review", "audit"])} THEN 'review'
  WHEN {_any_sql(["plan", "brainstorm"])} THEN 'plan' WHEN {_any_sql(["explain", "overview", "catalog"])} THEN 'explain' ELSE 'implement' END AS mode
FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS s FROM conversations)
""")
def x5_mode(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", X.mode_of(F.lower(F.coalesce("text", F.lit("")))).alias("mode"))


@query("SELECT doc_id, md5(replace(replace(lower(coalesce(text, '')), 'the', '###'), 'of th', '#####')) AS digest FROM documents")
def x6_mask_terms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.mask_terms(F.lower(F.coalesce("text", F.lit(""))), ["the", "of th"]).cast("binary")).alias("digest"))


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS collapse, md5(left(regexp_replace(text, '[ \t\n\r\f\x0B]+', '', 'g'), 200)) AS squeeze, md5(replace(source, '_', '-')) AS dash FROM documents WHERE text IS NOT NULL
""")
def x7_norm_keys(spark, sf_dir):
    key = lambda c, k: F.md5(X.norm_key(F.col(c), k).cast("binary")).alias(k)
    return docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", key("text", "collapse"), key("text", "squeeze"), key("source", "dash"))


@query(f"""
WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '数据库迁移' || left(text, 8) WHEN 2 THEN 'カナと漢字' || text ELSE left(text, 20) || '數' END AS s FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, length(s) AS n, length(regexp_replace(s, '[^{X.CJK}]', '', 'g')) AS c FROM d)
SELECT doc_id, CASE WHEN c > 0.3 * greatest(n, 1) THEN 'zh' WHEN c > 0 THEN 'mixed' ELSE 'en' END AS tag FROM n
""")
def x8_lang_tag(spark, sf_dir):
    m, text = F.col("doc_id") % 4, F.col("text")
    mixed = F.when(m == 0, text).when(m == 1, F.concat(F.lit("数据库迁移"), F.left(text, F.lit(8)))).when(m == 2, F.concat(F.lit("カナと漢字"), text)).otherwise(F.concat(F.left(text, F.lit(20)), F.lit("數")))
    return docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", X.lang_tag(mixed).alias("tag"))


@query("""
SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS hint_hash, event_type AS work_unit_id, CASE WHEN value IS NULL OR value < 0 THEN 0.0 ELSE round(value, 3) END AS duration_ms, CASE WHEN k >= 0 THEN k ELSE 0 END AS k
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""")
def x9_redact(spark, sf_dir):
    from ..sources.io import redact_event

    df = t(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("hint"), F.col("event_type").alias("work_unit_id"), F.col("value").alias("duration_ms"), F.get_json_object("props", "$.k").alias("k"))
    return redact_event(df, counts=["k"])


@query(r"""
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'audit' WHEN regexp_matches(base, '(?i)^readme(\.|$)') THEN 'readme' WHEN regexp_matches(p || '/', '(?i)(^|/)api/') THEN 'api' WHEN regexp_matches(p || '/', '(?i)(^|/)guides?/') THEN 'guide'
  WHEN page_id % 5 = 1 THEN 'arch' WHEN page_id % 5 = 2 THEN 'api' WHEN page_id % 5 = 3 AND regexp_matches(title, '(?i)standard|convention') THEN 'spec' WHEN page_id % 5 = 3 AND regexp_matches(title, '(?i)todo|backlog') THEN 'todo' WHEN page_id % 5 = 3 AND regexp_matches(title, '(?i)architecture|design') THEN 'arch' ELSE 'doc' END AS role
FROM (SELECT page_id, p, list_last(string_split(p, '/')) AS base, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM (SELECT *, regexp_extract(url, '^[^:]*://[^/?#]*/?([^?#]*)', 1) AS p FROM pages))
""")
def x12_doc_role(spark, sf_dir):
    """A text for each page: a role that it declares itself, a first heading (of two kinds, or the page's title), or nothing."""
    path, m = F.regexp_extract("url", r"^[^:]*://[^/?#]*/?([^?#]*)", 1), F.col("page_id") % 5
    heading = F.concat(F.lit("intro\n# "), F.when(m == 1, "The architecture").when(m == 2, "接口 list").when(m == 3, F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    text = F.when(m == 0, "---\nowner: x\ndocrole: Audit\n---\n# API\n").when(m < 4, heading).otherwise("no heading")
    return t(spark, sf_dir, "pages").select("page_id", E.doc_role(path, text).alias("role"))


@query(r"""
SELECT page_id, count(*) AS urls, sum(length(url)) AS chars, min(line_no) AS first_line FROM (
  SELECT page_id, url, min(line_no) AS line_no FROM (
    SELECT page_id, line_no, regexp_replace(unnest(regexp_extract_all(line, 'https?://[^\s<>"''`)\]]+')), '[.,;:!?]+$', '') AS url FROM (
      SELECT page_id, unnest(string_split(html || ' ' || url, chr(10))) AS line, unnest(range(1, len(string_split(html || ' ' || url, chr(10))) + 1)) AS line_no FROM pages)) GROUP BY 1, 2) GROUP BY 1
""")
def x14_extract_urls(spark, sf_dir):
    df = t(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", "html", "url").alias("body"))
    return E.extract_urls(df, "page_id", "body").groupBy("page_id").agg(F.count("*").alias("urls"), F.sum(F.length("url")).alias("chars"), F.min("line_no").cast("long").alias("first_line"))


@query(f"SELECT doc_id, regexp_matches(text, '{X.EMOJI}') AS emoji, regexp_matches(text, '[鍗鈫閫閮鎹鏄涓鍙鍧鍩鍨鐭鏉鏀鑴鏍]') AS mojibake FROM documents WHERE text IS NOT NULL")
def x15_emoji_mojibake(spark, sf_dir):
    return docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", X.has_emoji(F.col("text")).alias("emoji"), X.has_mojibake(F.col("text")).alias("mojibake"))


@query(r"""
WITH m AS (
  SELECT doc_id, 'regional_mail' AS kind, unnest(regexp_extract_all(coalesce(text, ''), '(?i)[a-z0-9._%+-]+@(?:qq|foxmail|163|126|139|sina|sohu|aliyun|yeah|189)\.(?:com|net|cn)')) AS match FROM documents
  UNION ALL SELECT doc_id, 'mobile', unnest(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z_]+'), lambda x: regexp_full_match(x, '1[3-9][0-9]{9}'))) FROM documents
  UNION ALL SELECT doc_id, 'home_path', unnest(regexp_extract_all(coalesce(text, ''), '(?i)(?:/users/|/home/)([a-z0-9_.-]+)/', 1)) FROM documents)
SELECT doc_id, kind, match FROM m WHERE NOT (kind = 'home_path' AND lower(match) = 'user')
""")
def x16_pii_findings(spark, sf_dir):
    return E.pii_findings(docs(spark, sf_dir), "doc_id", "text")


@query(r"""
SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(text, '[ \t]+\r?(\n|\z)') THEN 'trailing_space' END, CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 'missing_eof_newline' END, CASE WHEN contains(text, chr(13) || chr(10)) THEN 'crlf' END], lambda x: x IS NOT NULL)) AS issue FROM documents
""")
def x17_hygiene(spark, sf_dir):
    return E.hygiene_findings(docs(spark, sf_dir), "doc_id", "text")


@query(r"""
SELECT doc_id, md5(CASE WHEN ends_with(s, chr(10)) OR text = '' THEN s ELSE s || chr(10) END) AS digest FROM (SELECT doc_id, text, array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[ \t]+(\r?)$', '\1')), chr(10)) AS s FROM documents WHERE text IS NOT NULL)
""")
def x17_clean_text(spark, sf_dir):
    return docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.md5(E.clean_text(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, strlen(text) AS bytes FROM documents WHERE strlen(text) > 5242")
def x18_oversize(spark, sf_dir):
    return E.oversize(docs(spark, sf_dir), 0.005, "text").select("doc_id", F.col("bytes").cast("long").alias("bytes"))


GATES = [
    {"id": "licence", "pattern": r"(?i)licensed\s+under", "globs": ["*"], "once": True},
    {"id": "numbers", "pattern": "[0-9]{4,}", "globs": ["src*/**"], "exclude": ["src0/**"]},
    {"id": "break", "pattern": r"[a-z]\n+[A-Z]"},
]


@query(r"""
WITH f AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) AS file, coalesce(text, '') AS text FROM documents),
g AS (SELECT 'licence' AS gate, '(?i)licensed\s+under' AS p UNION ALL SELECT 'numbers', '[0-9]{4,}' UNION ALL SELECT 'break', '[a-z]\n+[A-Z]'),
s AS (SELECT gate, file, regexp_extract_all(text, '(?i)licensed\s+under') AS m, regexp_split_to_array(text, '(?i)licensed\s+under') AS b FROM f, g WHERE gate = 'licence'
  UNION ALL SELECT gate, file, regexp_extract_all(text, '[0-9]{4,}'), regexp_split_to_array(text, '[0-9]{4,}') FROM f, g WHERE gate = 'numbers' AND file NOT LIKE 'src0/%'
  UNION ALL SELECT gate, file, regexp_extract_all(text, '[a-z]\n+[A-Z]'), regexp_split_to_array(text, '[a-z]\n+[A-Z]') FROM f, g WHERE gate = 'break'),
h AS (SELECT gate, file, len(m) AS total, i, m[i] AS match, len(array_to_string(b[1:i], '')) - len(replace(array_to_string(b[1:i], ''), chr(10), '')) + len(array_to_string(m[1:i - 1], '')) - len(replace(array_to_string(m[1:i - 1], ''), chr(10), '')) + 1 AS line
  FROM (SELECT *, unnest(range(1, least(len(m), 50) + 1)) AS i FROM s))
SELECT gate, file, line, match, CAST(NULL AS BIGINT) AS total FROM h WHERE gate <> 'licence' OR i = 1
UNION ALL SELECT gate, file, 0, NULL, total FROM h WHERE i = 50 AND total > 50 AND gate <> 'licence'
""")
def x19_regex_gate(spark, sf_dir):
    df = docs(spark, sf_dir).select(F.concat_ws("/", "source", "doc_id").alias("file"), "text")
    return E.regex_gate(df, GATES, "file", "text").select("gate", "file", F.col("line").cast("long").alias("line"), "match", "total")


_URL = r"""(?i)(?:https?|hxxps?)://(?:\[\.\]|[^\s<>\"''`)\[\]])*[^\s<>\"''`)\[\].,;:!?]"""


@query(rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '\r$', '') AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM t),
m AS (SELECT *, 'email' AS kind, unnest(regexp_extract_all(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}')) AS v FROM l
  UNION ALL SELECT doc_id, line, line_no, 'hash' || length(v), v FROM (SELECT *, unnest(regexp_extract_all(line, '[0-9A-Fa-f]+')) AS v FROM l) WHERE length(v) IN (32, 40, 64)
  UNION ALL SELECT *, 'url', unnest(regexp_extract_all(line, '{_URL}')) FROM l
  UNION ALL SELECT doc_id, line, line_no, 'ipv4', v FROM (SELECT *, unnest(regexp_extract_all(line, '[0-9.]+')) AS v FROM l) WHERE regexp_full_match(v, '(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}')
  UNION ALL SELECT doc_id, line, line_no, 'domain', v FROM (SELECT *, unnest(regexp_extract_all(line, '(?i)[a-z0-9@./-]+')) AS v FROM l) WHERE regexp_full_match(v, '(?i)(?:[a-z0-9-]+\.)+(?:com|net|org|io|info|biz|ru|cn)')
  UNION ALL SELECT *, 'path', unnest(regexp_extract_all(line, '(?:^|[^A-Za-z0-9/.])(/(?:etc|usr|var|tmp|home|opt|bin)/[^\s\"<>|]+)', 1)) FROM l
  UNION ALL SELECT *, 'path', unnest(regexp_extract_all(line, '(?:^|[^A-Za-z0-9])([A-Za-z]:\\[^\s\"<>|]+)', 1)) FROM l
  UNION ALL SELECT *, 'user_agent', unnest(regexp_extract_all(line, 'Mozilla/[0-9.]+ \([^)]*\)[^\"\n]*')) FROM l),
k AS (SELECT doc_id, line_no, line, CASE kind WHEN 'hash32' THEN 'md5' WHEN 'hash40' THEN 'sha1' WHEN 'hash64' THEN 'sha256' ELSE kind END AS kind, CASE WHEN kind LIKE 'hash%' OR kind = 'domain' THEN lower(v) ELSE v END AS v FROM m)
SELECT kind, v AS indicator, CASE kind WHEN 'path' THEN 'contextual' ELSE 'high' END AS confidence, count(DISTINCT doc_id) AS docs, count(*) AS hits, min(doc_id) AS doc, md5(min_by(line, doc_id * 1000000 + line_no)) AS evidence FROM k GROUP BY 1, 2
""")
def x21_indicators(spark, sf_dir):
    out = E.extract_indicators(docs(spark, sf_dir), "doc_id", "text")
    return out.select("kind", "indicator", "confidence", "docs", "hits", "doc", F.md5(F.col("evidence").cast("binary")).alias("evidence"))


LOCATORS = {"tag": "title", "css": "css:head > title", "path": "xpath://head/title[1]", "links": "nav li a[href^='/']"}


@query(r"""
WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS inside FROM pages WHERE html LIKE '%<title>%'),
l AS (SELECT page_id, unnest(x) AS whole, CAST(unnest(range(0, len(x))) AS INTEGER) AS ord FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="/[^"]*">[^<]*</a>') AS x FROM pages))
SELECT page_id, locator, CAST(0 AS INTEGER) AS ord, inside, '<title>' || inside || '</title>' AS whole FROM t, (SELECT unnest(['tag', 'css', 'path']) AS locator)
UNION ALL SELECT page_id, 'links', ord, regexp_extract(whole, '>([^<]*)<', 1), whole FROM l
""")
def x22_html_elements(spark, sf_dir):
    out = None
    for name, locator in LOCATORS.items():
        found = E.html_elements(t(spark, sf_dir, "pages"), "page_id", "html", locator).select("page_id", F.lit(name).alias("locator"), "ord", F.col("inner").alias("inside"), F.col("outer").alias("whole"))
        out = found if out is None else out.unionByName(found)
    return out


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<a href="')) AS n_links FROM pages WHERE html LIKE '%<a href="%'""")
def x22_html_links(spark, sf_dir):
    return E.html_elements(t(spark, sf_dir, "pages"), "page_id", "html", "a", attr="href").groupBy("page_id").agg(F.count("*").alias("n_links"))


@query(r"""
WITH s AS (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS s FROM pages),
l AS (SELECT page_id, script, unnest(string_split(source, chr(10))) AS line, unnest(range(1, len(string_split(source, chr(10))) + 1)) AS line_no FROM (SELECT page_id, unnest(s) AS source, unnest(range(0, len(s))) AS script FROM s))
SELECT page_id, script, CAST(NULL AS VARCHAR) AS src, line_no, left(trim(line), 240) AS preview FROM l WHERE contains(lower(line), 'track(')
UNION ALL SELECT page_id, len(s), '/a0.js', 2, 'y = Track(1)' FROM s WHERE page_id % 3 = 0
UNION ALL SELECT page_id, NULL, '/a1.js', NULL, 'http_404' FROM s WHERE page_id % 3 = 1 UNION ALL SELECT page_id, NULL, '/a2.js', NULL, 'not_loaded' FROM s WHERE page_id % 3 = 2
""")
def x23_search_sources(spark, sf_dir):
    """Inline scripts of the pages, and one more with a source for each page: fetched, failed or not there."""
    pages = t(spark, sf_dir, "pages").withColumn("html", F.concat("html", F.lit('<script async src="/a'), F.col("page_id") % 3, F.lit('.js"></script>')))
    external = spark.createDataFrame([("/a0.js", 200, "x\n  y = Track(1) \n"), ("/a1.js", 404, "track(")], "src string, status int, source string")
    found, skipped = E.search_sources(pages, "track(", "page_id", "url", "html", external=external)
    none = F.lit(None).cast("long")
    found = found.select("page_id", F.col("script").cast("long").alias("script"), "src", F.col("line_no").cast("long").alias("line_no"), "preview")
    return found.unionByName(skipped.select("page_id", none.alias("script"), "src", none.alias("line_no"), F.col("reason").alias("preview")))


@query(r"""
WITH p AS (SELECT page_id, url || chr(10) || html || chr(10) || CASE page_id % 5 WHEN 0 THEN '@GET("/x") @PUT' WHEN 1 THEN 'const BASE_URL = "https://api.x/v1"' WHEN 2 THEN 'new WebSocket("wss://a.b/c")' WHEN 3 THEN 'graphql: mutation Add($x: Int)' ELSE '' END AS t FROM pages),
l AS (SELECT page_id, unnest(string_split(t, chr(10))) AS line FROM p),
m AS (SELECT page_id, 'absolute' AS kind, len(regexp_extract_all(line, 'https?://[^\s"''<>]+')) AS n FROM l UNION ALL SELECT page_id, 'retrofit', len(regexp_extract_all(line, '@(?:GET|POST|PUT|DELETE|PATCH|HEAD|HTTP)\b')) FROM l
  UNION ALL SELECT page_id, 'base_url', len(regexp_extract_all(line, '(?i:base_?url)\s*[(=:]\s*["''][^"'']+')) FROM l UNION ALL SELECT page_id, 'websocket', len(regexp_extract_all(line, 'wss?://[^\s"''<>]+|(?i:websocket)')) FROM l
  UNION ALL SELECT page_id, 'graphql', len(regexp_extract_all(line, '(?i:graphql)|(?i:\bmutation\s+\w+\s*[({])')) FROM l)
SELECT page_id, kind, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1, 2 HAVING sum(n) > 0
""")
def x24_api_surface(spark, sf_dir):
    """The urls and sources of the pages, with a line of one of the other marks."""
    m = F.col("page_id") % 5
    more = F.when(m == 0, '@GET("/x") @PUT').when(m == 1, 'const BASE_URL = "https://api.x/v1"').when(m == 2, 'new WebSocket("wss://a.b/c")').when(m == 3, "graphql: mutation Add($x: Int)").otherwise("")
    pages = t(spark, sf_dir, "pages").select("page_id", F.concat_ws("\n", "url", "html", more).alias("source"))
    return E.api_surface(pages, "page_id", "source").groupBy("page_id", "kind").agg(F.count("*").alias("n"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line_no FROM documents),
w AS (SELECT doc_id, line_no, line, sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS o FROM l)
SELECT doc_id, line_no, unnest(regexp_extract_all(line, 'AKIA[0-9A-Z]{16}|[0-9]{16}')) AS id, 'tokens' AS mode FROM w WHERE o % 2 = 0 AND NOT regexp_matches(line, '^\s*(```|~~~)')
""")
def x26_id_defs(spark, sf_dir):
    return E.id_defs(E.lines_of(docs(spark, sf_dir), "doc_id", "text", fences=True), "AKIA[0-9A-Z]{16}|[0-9]{16}", ["tokens"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "id", "mode")


@query("""
SELECT c_custkey AS doc, unnest([3, 4, 5, 6, 2, 1]) AS line_no, unnest(['O' || c_custkey, 'L' || c_custkey % 7, 'T' || c_custkey, 'J' || c_custkey, 'B1', 'F' || c_custkey]) AS id, unnest(['heading', 'bold', 'table', 'json', 'section_list', 'filename']) AS mode FROM customer
""")
def x26_id_sites(spark, sf_dir):
    """A text and a file name for each customer, with a definition of every kind, and one inside a fence that is none.

    A few bytes a customer become a text, so customers are dealt before that: tables of some MB would be read, and searched, by one task or two.
    """
    k = F.col("c_custkey")
    c = t(spark, sf_dir, "customer").select(k)
    c = c.repartition(max(1, -(-c.count() // TEXTS_A_TASK)), k)
    text = F.concat_ws("\n", F.lit("## B. list"), F.lit("1. first, not L1"), F.concat(F.lit("# O"), k, F.lit(" and more")), F.concat(F.lit("- **L"), k % 7, F.lit("** x")), F.concat(F.lit("| `T"), k, F.lit("` | O9 |")), F.concat(F.lit('{"id": "J'), k, F.lit('"}')), F.lit("```"), F.lit("# O1"), F.lit("```"))
    lines = E.lines_of(c.select(k.alias("doc"), text.alias("text")), "doc", "text", fences=True)
    sites = E.id_defs(lines, "[OLTJ][0-9]+", ["table", "heading", "bold", "json", "section_list"], "doc")
    files = E.id_files(c.select(F.concat(F.lit("adr/F"), k, F.lit("-of-some.md")).alias("path")), "F[0-9]+")
    out = sites.unionByName(files.select(F.regexp_extract("path", "F([0-9]+)", 1).cast("long").alias("doc"), "line_no", "id", "mode"))
    return out.select(F.col("doc").cast("long").alias("doc"), F.col("line_no").cast("long").alias("line_no"), "id", "mode")


@query("""
WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, o_orderstatus AS s, 2 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line_no FROM orders),
r AS (SELECT doc, k, line_no, 'O' || (2 * k) AS id, EXISTS (SELECT 1 FROM o d WHERE d.k = 2 * o.k AND d.s = 'F') AS g, false AS l FROM o
  UNION ALL SELECT doc, k, line_no, 'L' || ((k + 1) % 7), ((k + 1) % 7) IN (SELECT k % 3 FROM o WHERE s = 'P'), EXISTS (SELECT 1 FROM o d WHERE d.doc = o.doc AND d.s = 'O' AND d.k % 7 = (o.k + 1) % 7) FROM o)
SELECT doc, line_no, id, g OR l AS defined, CASE WHEN l THEN 'local' WHEN g THEN 'global' END AS scope FROM r
""")
def x27_id_refs(spark, sf_dir):
    """A text for each customer with two lines an order: what it defines (a heading, everywhere; a bold start, here; a table cell, everywhere),
    and what it refers to."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    defines = F.when(s == "F", F.concat(F.lit("# O"), k)).when(s == "O", F.concat(F.lit("**L"), k % 7, F.lit("** here"))).otherwise(F.concat(F.lit("| L"), k % 3, F.lit(" | of all |")))
    refers = F.concat(F.lit("see O"), 2 * k, F.lit(" and L"), (k + 1) % 7, F.lit(", L"), (k + 1) % 7, F.lit(", not xO1 or O1-a"))
    texts = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), F.concat(defines, F.lit("\n"), refers).alias("t")))).alias("x"))
    lines = E.lines_of(texts.select("doc", F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("text")), "doc", "text", fences=True)
    everywhere = E.id_defs(lines, "[OL][0-9]+", ["heading", "table"], "doc")
    return E.id_refs(lines, ["O[0-9]+", "L[0-9]+"], everywhere, "doc", local=E.id_defs(lines, "L[0-9]+", ["bold"], "doc")).select("doc", F.col("line_no").cast("long").alias("line_no"), "id", "defined", "scope")


@query(r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line_no FROM documents)
SELECT doc_id, line_no, 'apache' AS rule FROM l WHERE regexp_matches(line, '(?i)apache license')
UNION ALL SELECT doc_id, line_no, 'password' FROM l WHERE regexp_matches(line, 'password=')
""")
def x28_forbidden_markers(spark, sf_dir):
    rules = [{"id": "apache", "pattern": "(?i)apache license"}, {"id": "password", "pattern": "password=", "allow": ["never/**"]}]
    lines = E.lines_of(docs(spark, sf_dir).withColumn("doc", F.col("doc_id").cast("string")), "doc", "text")
    return E.forbidden_markers(lines, rules, "doc").select(F.col("doc").cast("long").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "rule")


@query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x29_cosine(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("other")), 4).alias("cosine"))


@query("SELECT doc_id, md5(concat_ws(': ', source, left(text, 160))) AS digest FROM documents WHERE text IS NOT NULL")
def x30_doc_text(spark, sf_dir):
    return docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.md5(X.doc_text(F.col("source"), F.col("text")).cast("binary")).alias("digest"))


@query(r"""
SELECT page_id, starts_with(url, 'https://') AND NOT contains(url, '?') AND len(list_filter(string_split(regexp_extract(url, '^[^:]*://[^/?#]*/?([^?#]*)', 1), '/'), lambda x: x <> '')) >= 2 AS valid FROM pages
""")
def x31_valid_source(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", E.valid_source(F.col("url"), F.lit("2024-01-01")).alias("valid"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(regexp_extract(url, '://[^/]*/(.*)$', 1), '^(?:[^/]+/)*[0-9][^/]*[.]html$')")
def p1_glob(spark, sf_dir):
    path = F.regexp_extract("url", "://[^/]*/(.*)$", 1)
    digits = [P.glob_match(path, f"**/{d}*.html") for d in range(10)]
    hit = digits[0]
    for d in digits[1:]:
        hit = hit | d
    return t(spark, sf_dir, "pages").filter(hit).select("page_id", "url")


@query("SELECT page_id FROM pages WHERE regexp_matches(list_last(string_split(regexp_extract(url, '://[^/]*/(.*)$', 1), '/')), '^[^/]*[.]html$') OR regexp_matches(regexp_extract(url, '://[^/]*/(.*)$', 1), '^fr/[^/]*$')")
def p2_match_any(spark, sf_dir):
    return t(spark, sf_dir, "pages").filter(P.match_any(F.regexp_extract("url", "://[^/]*/(.*)$", 1), ["*.html", "fr/*"])).select("page_id")


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'campaign' WHEN p_type LIKE 'S%' THEN 'plain' WHEN p_type = 'ECONOMY' OR p_type = 'LARGE' THEN 'volume' END AS domain FROM part")
def p3_domain(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", P.domain_of(F.col("p_type"), [("campaign", "PROMO"), ("plain", "S*|PROMO"), ("volume", "ECONOMY|LARGE")]).alias("domain"))


@query("SELECT event_id, event_type FROM events WHERE contains(lower(event_type), 'i') AND upper(event_type) = 'VIEW' ORDER BY ts DESC, event_id DESC LIMIT 100")
def p4_filter_requests(spark, sf_dir):
    df = t(spark, sf_dir, "events").withColumn("method", F.col("event_type"))
    return L.filter_requests(df, "I", "view", 100, url="event_type", order=("ts", "event_id")).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE lower(event_type) IN ('error', 'click') AND contains(lower(props), '7')")
def p5_filter_levels(spark, sf_dir):
    return L.filter_levels(t(spark, sf_dir, "events"), ["Error", "CLICK"], "7", level_col="event_type", text_col="props").select("event_id")


@query("SELECT doc_id, md5(left(text, 500)) AS digest, length(text) > 500 AS truncated, length(text) AS full_length FROM documents WHERE text IS NOT NULL")
def p6_truncate(spark, sf_dir):
    out = L.truncate_bodies(docs(spark, sf_dir).filter("text IS NOT NULL"), 500, "text")
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "truncated", "full_length")


@query("SELECT doc_id, left(text, 80) AS excerpt, length(text) AS n FROM documents")
def p7_excerpt(spark, sf_dir):
    a, n = X.excerpt(F.col("text"), 80)
    return docs(spark, sf_dir).select("doc_id", a.alias("excerpt"), n.alias("n"))


@query(r"""
SELECT conv_id, turn, md5(h) AS digest FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS h FROM conversations WHERE text IS NOT NULL)
WHERE length(h) BETWEEN 10 AND 4000 AND NOT regexp_matches(h, '^[\p{L}\p{N}_\-./\\: ]+$') AND NOT starts_with(h, 'Continue') AND h NOT IN ('ok', 'yes', 'go', 'next')
""")
def p8_clean_hints(spark, sf_dir):
    return L.clean_hints(t(spark, sf_dir, "conversations")).select("conv_id", "turn", F.md5(F.col("hint").cast("binary")).alias("digest"))


@query("SELECT event_id, nullif(trim(json_extract_string(props, '$.k')), '') AS picked FROM events")
def p11_pick_field(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", X.pick_field(F.col("props"), ["missing", "k"]).alias("picked"))


@query("""
WITH p AS (SELECT p_partkey AS id, list_sort(list_distinct(list_filter([CASE WHEN regexp_matches(p_name, 'bolt|gear') THEN 'metal' END, CASE WHEN regexp_matches(p_name, 'ring') THEN 'round' END, CASE WHEN regexp_matches(p_name, '^[a-c]') THEN 'early' END], lambda x: x IS NOT NULL))) AS jobs FROM part),
u AS (SELECT bool_or(len(jobs) = 0) AS up FROM p)
SELECT id, array_to_string(list_sort(CASE WHEN up THEN list_append(jobs, 'all') ELSE jobs END), ',') AS jobs FROM p, u
""")
def p14_rule_fanout(spark, sf_dir):
    rules = [("bolt|gear", "metal", False), ("ring", "round", False), ("^[a-c]", "early", False)]
    return L.rule_fanout(t(spark, sf_dir, "part"), rules, "p_partkey", "p_name").select("id", F.array_join("jobs", ",").alias("jobs"))


@query("SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') <= 365 AS fresh FROM orders")
def p15_is_fresh(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", L.is_fresh(F.col("o_orderdate"), F.lit(365), F.lit("1998-01-01").cast("date")).alias("fresh"))
