"""Operators 3, 4 and 6: held-out accuracy on the given tables, deobfuscation, awkward rows."""

import tracemalloc
from collections import Counter
from itertools import product
from math import exp, log

import numpy as np
from pyspark.sql import functions as F

from weir.llm import language_id, quality_model, queries, toxicity

from .common import awkward, clashing, empty


def sf01(sf):
    return sf.replace("sf0.001", "sf0.01")


def test_language_held_out(spark, sf):
    d = sf01(sf)
    got = queries.op3_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    docs = awkward(spark)
    m = language_id.train(docs)
    got = {r["doc_id"]: r for r in language_id.predict(clashing(docs), m).collect()}
    assert (got[100]["lang_pred"], got[101]["lang_pred"], got[102]["lang_pred"], got[106]["lang_pred"]) == ("und",) * 4
    assert got[103]["lang_pred"] == "en" and got[105]["lang_pred"] == "de" and got[104]["lang_pred"] in ("en", "de")
    nothing = language_id.train(empty(spark))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(empty(spark), m).count() == 0


def test_backoff_goes_to_shorter_grams(spark):
    rows = [(i, t, lang, "", 0) for i, (t, lang) in enumerate([("schule schaf schiff schnee schuh schon", "de"), ("school ship sheep snow shoe show", "en")] * 3)]
    m = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert m.predict("schinken")[0] == "de" and m.predict("shower")[0] == "en" and m.predict("SCHULE")[0] == "de"


def test_language_scores_by_a_plain_scorer(spark):
    rows = [(1, "der hund und der wald und das haus", "de"), (2, "the dog and the wood and the house und", "en"), (3, "le chien et le bois et la maison", "fr"), (4, "Der Wald", "de"), (5, None, "de"), (6, "no language", None)]
    setup = language_id.LanguageSetup()
    m = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), setup)
    words, grams = {}, {}
    for _, t, lang in rows:
        if t and lang:
            words.setdefault(lang, Counter()).update(t.lower().split())
    for lang, counts in words.items():
        for w, n in counts.items():
            for size in range(1, setup.longest + 1):
                for g in language_id.grams_of(w, size):
                    grams.setdefault(lang, Counter())[g] += n**0.5
    names = sorted(words)

    def logs(table, key):
        kinds = len({k for c in table.values() for k in c})
        return [log((table[x][key] + setup.smoothing) / (sum(table[x].values()) + setup.smoothing * kinds)) for x in names]

    def score(w):
        if any(w in c for c in words.values()):
            return np.array(logs(words, w))
        for size in range(setup.longest, 0, -1):
            known = [g for g in language_id.grams_of(w, size) if any(g in c for c in grams.values())]
            if known:
                return np.mean([logs(grams, g) for g in known], axis=0) * setup.unknown_weight
        return np.zeros(len(names))

    for text in ("der wald", "the woods and hounds", "maisons maisons maisons und", "wälder", "qqq zzz", "houses und und und und und und hunde", "dog"):
        total = sum((1 + log(n)) * (score(w) - score(w).mean()) for w, n in Counter(text.split()).items())
        got = m.predict(text)
        assert got[0] == names[int(np.argmax(total))] or not np.any(total), text
        assert abs(got[1] - 1 / sum(exp(x - max(total)) for x in total)) < 1e-3 or not np.any(total), text


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(3)
    word = lambda k: "".join(chr(97 + (k * 7 + int(c)) % 26) for c in rng.integers(0, 5, 6))
    rows = [(i, " ".join(word(i % 230) for _ in range(8)), f"l{i % 230:03d}") for i in range(460)] + [(1000 + i, "the common one of all", "l000") for i in range(3000)]
    m = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), language_id.LanguageSetup(max_rows=600))
    assert len(m.languages) == 230 and np.mean([m.predict(t)[0] == x for _, t, x in rows[:460]]) > 0.95
    assert language_id._quota([1, 2, 1000], 9) == 6 and language_id._quota([5, 5], 100) == 5 and language_id._quota([], 5) == 0 and language_id._quota([9] * 50, 10) == 1


def enumerated(grams, choices, breaks):
    """The best log likelihood of all paths, one by one."""
    g, best = grams.reshape(64, 64, 64), -np.inf
    for path in product(*choices):
        for spaced in product(*([(0, 1)] * len(path) if breaks else [(0,)] * len(path))):
            a = b = 0
            p, ok = 0.0, True
            for (letter, cost), space in zip(path, spaced, strict=True):
                if space:
                    if not b:
                        ok = False
                        break
                    p, a, b = p + g[a, b, 0], b, 0
                p += cost
                if letter:
                    c = toxicity.symbol(letter)
                    p, a, b = p + g[a, b, c], b, c
            if ok:
                best = max(best, p + (g[a, b, 0] if b or not breaks else 0.0))
    return best


def test_no_language_is_left_out_of_the_sample(spark):
    rows = spark.createDataFrame([(f"l{k}", f"l{k}-{i}", "word " * 10) for k in range(300) for i in range(5)] + [("big", f"b{i}", "word") for i in range(3000)], "lang string, id string, text string")
    for bound, most in ((300, 301), (700, 305 + 700), (10**6, 10**6)):
        drawn, counts = language_id.even_sample(rows, "id", "lang", bound)
        n = {r["lang"]: r["count"] for r in drawn.groupBy("lang").count().collect()}
        assert len(n) == len(counts) == 301 and sum(n.values()) <= most
    assert n == counts
    drawn, _ = language_id.even_sample(rows, "id", "lang", 10**6, "text", 301 * 100)
    n = {r["lang"]: r["count"] for r in drawn.groupBy("lang").count().collect()}
    assert len(n) == 301 and n["big"] == 25 and set(n.values()) == {2, 25}
    assert language_id.even_sample(rows.limit(0), "id", "lang", 5)[0].count() == 0


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(1)
    for k, token in enumerate(("1d1ot", "$tup!d", "a1|1b", "llloooo", "x..y", "10|+", "@@", "é0ß", "1", "")):
        grams = np.log(rng.dirichlet(np.ones(64), 64 * 64)).astype(np.float32).ravel()
        r = toxicity.Restorer(grams)
        for breaks in (False, True):
            want = enumerated(grams.astype(np.float64), r.choices(token), breaks)
            for states in (24, 0, 3):
                score, said = r.decode(token, breaks, states)
                assert abs(score - want) < 1e-4, (token, breaks, states)
                assert breaks or " " not in said
    # long tokens of many states: both ways agree
    for token in ("3f4a9b1|0!@5" * 8, "the1d10t$" * 6, "0123456789" * 5):
        for breaks in (False, True):
            one, many = r.decode(token, breaks, 10**9), r.decode(token, breaks, 0)
            assert abs(one[0] - many[0]) < 1e-3 and (one[1] == many[1] or abs(one[0] - many[0]) < 1e-4)


def test_long_tokens_are_settled_on_the_way(monkeypatch):
    rng = np.random.default_rng(3)
    grams = np.log(rng.dirichlet(np.ones(64), 64 * 64)).astype(np.float32).ravel()
    r = toxicity.Restorer(grams)
    some = ["".join(rng.choice(list(letters), 300)) for letters in ("0123456789abcdef", "abcXYZ019+/=", "aab1!", "aaa", "1@$", "ab.")]
    want = {(t, breaks, states): r.decode(t, breaks, states) for t in some for breaks in (False, True) for states in (24, 0)}
    monkeypatch.setattr(toxicity, "COMMIT", 7)
    for (t, breaks, states), (score, said) in want.items():
        again = r.decode(t, breaks, states)
        assert abs(again[0] - score) < 1e-6 and again[1] == said, (t, breaks, states)


def test_memory_of_a_long_token_is_bounded():
    rng = np.random.default_rng(4)
    grams = np.log(rng.dirichlet(np.ones(64), 64 * 64)).astype(np.float32).ravel()
    r = toxicity.Restorer(grams)
    peaks = {}
    for n in (10_000, 30_000):
        for letters in ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789+/"):
            token = "".join(rng.choice(list(letters), n))
            tracemalloc.start()
            r.decode(token, True)
            peaks[letters, n] = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
    assert max(peaks.values()) < 8_000_000 and all(p < 3 * peaks[letters, 10_000] for (letters, n), p in peaks.items())


def test_restores_hidden_words(spark):
    docs = spark.createDataFrame([("the stupid idiot is a worthless loser and the trash is in the house of the moron",)] * 20 + [("a quiet river and a silver window",)] * 20, "text string")
    r = toxicity.Restorer(toxicity.count_trigrams(docs))
    for hidden, word in (("1d1ot", "idiot"), ("$tup1d", "stupid"), ("l0ser", "loser"), ("tr@sh", "trash"), ("w0rthle$$", "worthless"), ("i.d.i.o.t", "idiot"), ("iiidiooot", "idiot")):
        assert word in r.words(hidden), (hidden, r.words(hidden))
    assert r.apart("you l o s e r there") == ["loser"] and r.words("window") == ["window"] and r.words("silver,") == ["silver"]
    assert r.apart("a b") == []


def test_restores_hidden_words_of_any_length(spark):
    docs = spark.createDataFrame([("you are a stupid idiot and the trash is in the house of a worthless loser",)] * 20 + [("a quiet river and a silver window",)] * 20, "text string")
    r = toxicity.Restorer(toxicity.count_trigrams(docs))
    assert "idiot" in r.words("i" * 45 + "diot")
    assert {"stupid", "worthless", "loser", "trash"} <= set(r.words("y0u.are.a.$tupid.idi0t.and.a.w0rthless.l0ser.and.trash"))
    said = "you are a stupid idiot and a worthless loser in the house of the trash"
    assert {"stupid", "idiot", "worthless", "loser", "trash"} <= set(r.apart("  ".join(" ".join(w) for w in said.split())))
    assert {"stupid", "idiot", "worthless", "loser", "trash"} <= set(r.apart(" ".join(said.replace(" ", ""))))
    assert "stupid" in r.apart("$ t u p ! d")


def test_trigram_counts_by_brute_force(spark):
    texts = ["Abc abd", None, "", "éa Ab"]
    got = toxicity.count_trigrams(spark.createDataFrame([(t,) for t in texts], "text string").repartition(1))
    assert got.shape == (64**3,) and np.isfinite(got).all()
    assert abs(np.exp(got.reshape(64, 64, 64)[0, 1]).sum() - 1) < 1e-3
    assert got[(0 * 64 + 1) * 64 + 2] == got.reshape(64, 64, 64)[0, 1].max()


def test_toxicity_held_out(spark, sf):
    d = sf.replace("sf0.001", "sf0.1")
    got = queries.op4_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    tp = sum(r["toxic"] == 1 and r["predicted"] == 1 for r in got)
    assert tp / sum(r["toxic"] == 1 for r in got) > 0.85 and tp / max(1, sum(r["predicted"] == 1 for r in got)) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_toxicity_edges(spark):
    docs = awkward(spark)
    labels = docs.filter("doc_id < 100").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label")).unionByName(spark.createDataFrame([(100, None), (101, 0)], "doc_id long, label int"))
    m = toxicity.train(docs, labels)
    assert toxicity.add_scores(clashing(docs), m, score="s1").filter("score = 'mine' AND s1 BETWEEN 0 AND 1").count() == docs.count()
    assert toxicity.score_documents(docs, m).count() == docs.count() and toxicity.score_documents(empty(spark), m).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score_documents(docs, none).filter("predicted = 1").count() == 0
    toxicity.train(empty(spark), labels)


def test_quality_held_out(spark, sf):
    d = sf01(sf)
    got = queries.op6_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_top_word_counts_whole_texts():
    top = quality_model.STATISTICS.index("top_word")
    first = [f"w{k}" for k in range(60)]
    for n in (40, 140, 141, 5000):
        assert abs(quality_model.measure(" ".join(first + ["spam"] * n))[top] - n / (n + 60)) < 1e-9
    assert quality_model.measure("")[top] == 0


def test_quality_edges(spark):
    docs = awkward(spark)
    measured = quality_model.measure_documents(clashing(docs))
    labels = docs.filter("doc_id < 50").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    for lab in (labels, labels.limit(0), labels.filter("label = 1")):
        out = quality_model.score_documents(measured, quality_model.train(measured, lab))
        assert out.filter("score BETWEEN 0 AND 1").count() == docs.count()
    assert quality_model.measure_documents(empty(spark)).count() == 0


def test_normal_equations_against_direct_ridge(spark):
    rng = np.random.default_rng(2)
    k, setup = len(quality_model.STATISTICS), quality_model.QualitySetup()
    x = rng.normal(size=(400, k)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=400) > 0).astype(float)
    measured = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "doc_id long, x array<float>")
    m = quality_model.train(measured, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, label int"), setup)
    z = m.lift(x.astype(np.float64))
    assert np.allclose(m.mean, x.mean(axis=0), atol=1e-5) and np.allclose(m.spread, x.std(axis=0), atol=1e-5)
    d = z.shape[1]
    direct = np.linalg.lstsq(np.vstack([z, np.sqrt(setup.ridge * len(z)) * np.eye(d)]), np.r_[y, np.zeros(d)], rcond=None)[0]
    assert np.allclose(z @ direct, m.raw(x.astype(np.float64)), atol=1e-6)
    # random features approximate the kernel
    gap = ((x[:50, None] - x[None, :50]) / m.spread) ** 2
    lifted = m.lift(x[:50].astype(np.float64))[:, : setup.features]
    assert np.abs(lifted @ lifted.T - np.exp(-gap.sum(axis=2) / (2 * setup.width**2))).mean() < 0.08
    # calibration: isotonic on the bins of the raw scores
    raw = m.raw(x.astype(np.float64))
    bins = np.round(np.clip(raw, -0.5, 1.5) * (setup.bins / 2))
    at = [(raw[bins == b].mean(), y[bins == b].sum(), (bins == b).sum()) for b in np.unique(bins)]
    level = [(s + y.mean()) / (n + 1) for _, s, n in at]
    weight = [n + 1 for *_, n in at]
    # least squares among non-decreasing sequences, by the greatest of least means
    mean = lambda i, j: np.average(level[i : j + 1], weights=weight[i : j + 1])
    fit = [max(min(mean(i, j) for j in range(q, len(level))) for i in range(q + 1)) for q in range(len(level))]
    assert np.allclose(m.levels, fit, atol=1e-9) and np.all(np.diff(m.levels) >= -1e-12)


def test_statistics_by_hand_and_around_old_bounds():
    got = dict(zip(quality_model.STATISTICS, quality_model.measure("One two two. | 9\nOne two two. | 9"), strict=True))
    assert got["top_word"] == 2 / 10 and got["repeated_lines"] == 0.5 and got["digit_share"] == 2 / 24 and got["pipe_share"] == 2 / 24 and got["distinct_words"] == 0.5
    words = [f"w{k}" for k in range(199)]
    for n in (199, 200, 201, 202):
        text = " ".join((words * 2)[: n - 2] + ["end", "end"])
        assert abs(quality_model.measure(text)[quality_model.STATISTICS.index("top_word")] - 2 / n) < 1e-9


def test_isotonic():
    assert quality_model.isotonic(np.array([1.0, 3, 2, 4, 0]), np.ones(5)).tolist() == [1, 2.25, 2.25, 2.25, 2.25]
    assert quality_model.isotonic(np.zeros(0), np.zeros(0)).tolist() == []
