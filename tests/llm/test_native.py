"""Operators 1 and 10: contracts by brute force, no Python in the plans, awkward rows."""

import random
import re
from collections import Counter

from weir.llm import line_rules, queries, url_trust

from .common import awkward, clashing, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def judged(df):
    cols = ["doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return line_rules.judge(df).select(*cols).collect()


def test_base_counts_by_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += ["\n".join(rng.choice(["a b", "a  b", " ", "c d e f g h", "c d e f g h "]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    texts += ["a\x0bb\x0cc\u00a0d\u2003e f", "x " * 30000, "é|# \n\n\n\té|#"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in judged(df.unionByName(awkward(spark).select("doc_id", "text"))):
        assert tuple(r)[2:8] == brute(r["text"]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_lines_fail_by_rule_and_clean_text_stays(spark):
    good = "The quiet harbor kept its lanterns lit through the long winter morning.\n" * 1 + "A second line of plain words follows here."
    bad = good.split("\n")[0] + "\n" + "\n".join("one | two | three | four | five | six | seven" for _ in range(9))
    junk = " ".join(f"{w}***" for w in good.split()) + "."
    df = spark.createDataFrame([(1, good), (2, bad), (3, junk), (4, good + "\nLicensed under the Apache License, Version 2.0.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_rules.judge(df).collect()}
    assert [got[i]["kept"] for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert got[2]["n_failed_lines"] == 9 and got[4]["clean_text"] == good and got[3]["clean_text"] == ""


def test_line_rules_edges(spark):
    docs = awkward(spark)
    assert line_rules.judge(clashing(docs)).count() == docs.count()
    assert line_rules.judge(empty(spark)).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_plans_have_no_python(spark, sf):
    for q in ("op1_url_trust", "op10_line_rules"):
        assert not re.search("Python|Pandas|Arrow", plan(queries.queries()[q](spark, sf)))


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


URLS = ["http://A.Example.org/es/x?y#z", "https://example.org/en/12", "https://example.org", "x://a.org?q", "http://b.com/de/", "http://b.com/de", "nothing", None, "", "://x.com/fr/1", "a://b://c.org/d", "http://ÄÖ.org/É", "http://h.com/fr/a\nb", "http://example.org.evil.net/es/"]


def test_rules_by_brute_force(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)] + [(0, URLS[0], None)], "page_id long, url string, html string")
    out = url_trust.judge(clashing(pages), queries.POLICY).collect()
    assert len(out) == len(URLS) + 1
    for r in out:
        host, path, (rule, verdict) = brute_url(URLS[r["page_id"]], queries.POLICY)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert url_trust.judge(pages.limit(0), queries.POLICY).count() == 0


def page(i, host, path="/", *to):
    return (i, f"http://{host}{path}", "".join(f'<a href="http://{t}/x">' for t in to))


def test_trust_and_distrust_flow(spark):
    rows = [page(1, "good.org", "/", "friend.net", "friend2.net"), page(2, "friend.net", "/", "far.net"), page(3, "far.net"), page(4, "spam.com", "/de/"), page(5, "farm.net", "/", "spam.com"), page(6, "deep.net", "/", "farm.net"), page(7, "alone.net"), page(8, "friend2.net")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_trust.judge(pages, [("allow", "org", "/"), ("block", "com", "/de/")]).collect()}
    assert [got[i]["verdict"] for i in range(1, 9)] == ["allow", "allow", "allow", "block", "block", "block", "allow", "allow"]
    assert got[2]["trust"] > got[3]["trust"] > 0 and got[5]["distrust"] > got[6]["distrust"] > 0 and got[7]["trust"] == got[7]["distrust"] == 0


def test_propagation_settles_and_reaches_far_hosts(spark):
    rows = [page(0, "spam.com", "/de/")] + [page(k, f"h{k}.net", "/", f"h{k - 1}.net" if k > 1 else "spam.com") for k in range(1, 15)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_trust.judge(pages, [("block", "com", "/de/")]).collect()}
    assert all(got[k]["verdict"] == "block" and abs(got[k]["distrust"] / (0.15 * 0.85**k) - 1) < 1e-3 for k in range(1, 15))
    # two hosts that link to each other: settled shares are 1 and 0.85 of 1 / 1.85
    pair = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, w double")
    trust = {r["host"]: r["trust"] for r in url_trust.propagate(pair, spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")).collect()}
    assert abs(trust["a"] - 1 / 1.85) < 1e-3 and abs(trust["b"] - 0.85 / 1.85) < 1e-3


def test_propagation_by_brute_force(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(9), rng.randrange(9)): float(rng.randint(1, 4)) for _ in range(25)}
    edges = {e: w for e, w in edges.items() if e[0] != e[1]}
    links = spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in edges.items()], "src string, dst string, w double")
    seeds = spark.createDataFrame([("h0", 1.0, 0.0), ("h1", 0.5, 0.25), ("h2", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_trust.propagate(links, seeds, rounds=5, cut_every=2).collect()}
    for k, turn in enumerate((False, True)):
        e = {((b, a) if turn else (a, b)): w for (a, b), w in edges.items()}
        seed = [[1.0, 0.5, 0.0], [0.0, 0.25, 1.0]][k] + [0.0] * 6
        r = seed[:]
        for _ in range(5):
            r = [0.15 * seed[j] + 0.85 * sum(r[a] * w / sum(x for (c, _), x in e.items() if c == a) for (a, b), w in e.items() if b == j) for j in range(9)]
        assert all(abs(got.get(f"h{j}", (0, 0))[k] - r[j]) < 1e-9 for j in range(9))
