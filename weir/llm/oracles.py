"""DuckDB SQL of the corpus queries that SQL can express exactly."""

from __future__ import annotations

from .line_rules import LineRules

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = r"[\x20\x09-\x0D]+"
_SPLIT = "list_filter(regexp_split_to_array(%s, '" + _SPACES + "'), lambda x: x <> '')"

#: op7: all pairs by shared shingles, then everything reachable.
NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT % _LOWER} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT node, y FROM r JOIN l ON other = x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM (SELECT node AS doc_id, min(other) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)
"""

#: Benchmark windows, document words, and the items and words hit.
_HITS = rf"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' ')) END) AS s FROM b),
k AS (SELECT DISTINCT len(string_split(s, ' ')) AS n FROM v),
d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, k WHERE len(w) >= n),
h AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS s FROM g) JOIN v USING (s)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
"""

#: op8: every window of every document against the distinct windows of the items.
DECONTAMINATION = _HITS + """
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: near_matches: every stretch of 16 words around a phrase's rarest word against all its words.
NEAR_MATCHES = _HITS + """
, q AS (SELECT s, list_distinct(string_split(s, ' ')) AS terms FROM (SELECT DISTINCT s FROM v)),
f AS (SELECT word, count(*) AS df FROM (SELECT unnest(w) AS word FROM d) GROUP BY 1),
u AS (SELECT s, arg_min(term, df) AS rare FROM (SELECT s, unnest(terms) AS term FROM q) LEFT JOIN f ON word = term GROUP BY s HAVING count(*) = count(df)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
z AS (SELECT doc_id, s, pos - o AS first FROM p JOIN u ON word = rare, (SELECT unnest(range(0, 16)) AS o)),
n AS (SELECT DISTINCT z.doc_id, z.s FROM z JOIN d USING (doc_id) JOIN q USING (s) WHERE list_has_all(d.w[greatest(first, 1):first + 15], terms)),
m AS (SELECT doc_id, count(*) AS n_near, string_agg(x, ',' ORDER BY x) AS near_items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM n JOIN v USING (s)) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(n_near, 0) AS n_near, coalesce(near_items, '') AS near_items, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def line_rules(rules: LineRules = LineRules()) -> str:
    """op10: windows as rows, lines as rows."""
    strip = f"regexp_replace(%s, '{_SPACES}', '', 'g')"
    symbols = "length(regexp_replace(%s, '[^#*$%&|<>]', '', 'g'))"
    boilerplate = rules.boilerplate.replace("'", "''")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, {_SPLIT % 't'} AS w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 5)),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM g) WHERE k > 1) GROUP BY 1),
l AS (SELECT doc_id, line, length({strip % 'line'}) AS c, length(line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
f AS (SELECT *, {symbols.replace('%&', '%%&') % 'line'} > {rules.max_symbol_share} * c OR length(line) - length(replace(line, '|', '')) >= {rules.min_pipes}
  OR (c > {2 * rules.min_open_words} AND NOT regexp_matches(line, '[.!?:;,…。]') AND n - c >= {rules.min_open_words - 1}) OR regexp_matches(line, '{boilerplate}') AS bad FROM l WHERE c > 0),
a AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(c) FILTER (NOT bad), 0) AS good, sum(c) AS chars FROM f GROUP BY 1),
o AS (SELECT doc_id, len(w) AS n_words, coalesce(chars, 0) AS word_chars, {symbols.replace('%&', '%%&') % 't'} AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CASE WHEN chars > 0 THEN good / chars ELSE 0 END AS share
  FROM d JOIN w USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN a USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) AND share >= {1 - rules.max_lost_share} AS kept, round(share, 6) AS kept_share FROM o
"""

#: op12: all phrases as rows, their cuts, and the longer phrases that have them.
COLLOCATIONS = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, array_to_string(w[i:i+k-1], ' ') AS phrase, k FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY 1),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, k AS size, f AS a FROM f WHERE k > 1),
x AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k+1:], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT x.lang, x.phrase, a, x.k, l.f AS l, r.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (l.f + r.f) AS BIGINT) AS score FROM x JOIN f l ON l.lang = x.lang AND l.phrase = first JOIN f r ON r.lang = x.lang AND r.phrase = rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[i:i+k-1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, size, k, unnest(range(1, size - k + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS k) WHERE k < size) GROUP BY 1, 2),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT t.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000
"""

#: op13: the score of every anchor with every other row.
HARD_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS id, a.label = o.label AS same, CAST(list_inner_product(a.x, o.x) AS BIGINT) AS score FROM e a JOIN e o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
"""
