"""Operators 11, 12 and 13 against the tokenizers library and brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weir.llm import collocations, hard_negatives, packing, queries
from weir.llm.queries import vocabulary

from .common import LOWER, awkward, clashing, empty

BYTE = vocabulary("byte_bpe_50k.json")


# --- packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(2, 32), st.integers(1, 8))
def test_every_id_once_and_nothing_padded(lengths, window, most):
    packer = packing.Packer(window, most)
    docs = [np.arange(n, dtype=np.uint32) + 1000 * i for i, n in enumerate(lengths)]
    sequences = []
    for i, ids in enumerate(docs):
        sequences += packer.add(i, ids)
        assert packer.n_open == packer.level.sum() == sum(map(len, packer.at.values())) <= most
    sequences += packer.finish()
    sizes = [sum(len(p.ids) for p in s) for s in sequences]
    assert all(n == window or n & (n - 1) == 0 for n in sizes) and sum(n < window for n in sizes) <= window.bit_length()
    pieces = defaultdict(list)
    for p in (p for s in sequences for p in s):
        pieces[p.doc].append(p)
        assert p.doc_tokens == lengths[p.doc] and len(p.ids)
    for i, ids in enumerate(docs):
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at
            at += len(p.ids)
        assert [x for p in sorted(pieces[i], key=lambda p: p.start) for x in p.ids] == ids.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 19), max_size=40))
def test_level_of_least_squares(lengths):
    packer = packing.Packer(20, 10**6)
    for i, n in enumerate(lengths):
        squares = {}
        for h in range(20 - n + 1):
            if h == 0 or packer.level[h]:
                after = packer.level.copy()
                after[h] -= h > 0
                if h + n < 20:
                    after[h + n] += 1
                squares[h] = int((after**2).sum())
        best = packer._best(n)
        assert squares[best] == min(squares.values()) and best == max(h for h in squares if squares[h] == squares[best])
        list(packer.add(i, np.zeros(n, dtype=np.uint32)))


def test_packed_table(spark):
    docs = awkward(spark)
    docs = docs.unionByName(spark.createDataFrame([(200, " " * 300_000, "en", "s", 1), (201, "<|endoftext|> a <|endoftext|>", "en", "s", 1)], docs.schema))
    library = Tokenizer.from_file(BYTE)
    want = Counter()
    for r in docs.collect():
        want[r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids) + (1,)] += 1
    pieces = packing.pack_documents(clashing(docs), BYTE, open_windows=4).cache()
    rows = pieces.withColumn("crc", F.crc32("ids")).collect()
    ids = {r: np.frombuffer(r["ids"], "<u4").tolist() for r in rows}
    assert all(zlib.crc32(np.array(ids[r], "<u4").tobytes()) == r["crc"] and len(ids[r]) == r["length"] for r in rows)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0
    for (doc, tokens), held in by_doc.items():
        one = [t for (i, t) in want if i == doc and len(t) == tokens]
        copies = sum(n for (i, t), n in want.items() if i == doc and len(t) == tokens)
        assert sum(r["length"] for r in held) == tokens * copies
        assert all(ids[r] == list(one[0][r["start"] : r["start"] + r["length"]]) for r in held) or len(one) > 1
    assert {(i, len(t)) for i, t in want} == set(by_doc)
    made = {r["sequence_id"]: r for r in packing.assemble(pieces).collect()}
    for s, held in by_sequence.items():
        held = sorted(held, key=lambda r: r["offset"])
        assert np.frombuffer(made[s]["ids"], "<u4").tolist() == [x for r in held for x in ids[r]] and made[s]["n_tokens"] == sum(r["length"] for r in held)
        assert [tuple(d) for d in made[s]["documents"]] == [(r["doc_id"], r["start"], r["length"]) for r in held]
    assert packing.pack_documents(empty(spark), BYTE).count() == 0


def test_whole_documents_where_there_is_room(spark, sf):
    rows = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), BYTE).drop("ids").collect()
    n = Counter(r["doc_id"] for r in rows)
    assert len(rows) and sum(n[r["doc_id"]] > math.ceil(r["doc_tokens"] / 2048) for r in rows if r["start"] == 0) < 0.1 * len(n)


# --- collocations


def phrases_by_hand(rows, support, longest=4):
    f, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    return {k: v for k, v in f.items() if v >= support}, totals


def collocations_by_hand(rows, support, best):
    f, totals = phrases_by_hand(rows, support)
    out = defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) == 1 or any(len(x) > len(w) and 100 * b >= 80 * a and any(x[i : i + len(w)] == w for i in range(len(x))) for (o, x), b in f.items() if o == lang):
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, totals[lang], -s) for lang, held in out.items() for i, (s, a, p, left, right) in enumerate(sorted(held)[:best], 1))


def texts_with_phrases(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "New", "york", "stock", "exchange", "ß", "日本", "x" * 300, "\x00", "é"]
    rows = []
    for i in range(150):
        said = []
        for _ in range(rng.randint(0, 40)):
            said += rng.choice([["new", "York", "Stock", "exchange"], ["a", "b"], [rng.choice(words)], [rng.choice(words)]])
        rows.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " "]) for w in said), rng.choice(["en", "en", "de", None, ""])))
    return [*rows, (None, "en"), ("", None), ("a " * 3000, "en"), (" \t.;", "fr"), *[("ha " * 50, "und")] * 3]


@pytest.mark.parametrize("setup", [{}, {"most_bits": 64}, {"shards": 1}, {"shards": 40}])
def test_collocations_equal_brute_force(spark, monkeypatch, setup):
    monkeypatch.setattr(collocations, "HELD", 500)
    monkeypatch.setattr(collocations, "WORDS", 300)
    rows = texts_with_phrases(3)
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    got = collocations.mine(docs.withColumns({c: F.lit("mine") for c in ("phrase", "h", "n", "f", "words", "size", "rank")}), support=30, best=7, **setup)
    assert sorted(map(tuple, got.collect())) == collocations_by_hand(rows, 30, 7)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | {c: "bigint" for c in ("rank", "a", "l", "r", "n", "score")}


def test_phrase_counts_and_empty_tables(spark):
    rows = texts_with_phrases(4)
    docs = spark.createDataFrame(rows, "text string, lang string")
    want, totals = phrases_by_hand(rows, 5, 6)
    got = collocations.count_phrases(docs, support=5, longest=6)
    assert {(r["lang"], r["phrase"]): r["f"] for r in got.filter("phrase <> ''").collect()} == {(lang, " ".join(w)): n for (lang, w), n in want.items()}
    assert {r["lang"]: r["f"] for r in got.filter("phrase = ''").collect()} == {k: n for k, n in totals.items() if n}
    assert collocations.mine(empty(spark)).count() == 0
    assert {(r["lang"], r["phrase"]): r["f"] for r in collocations.count_phrases(docs, support=5, longest=1).filter("phrase <> ''").collect()} == {(lang, w[0]): n for (lang, w), n in want.items() if len(w) == 1}


def test_counts_past_64_bits_stay_exact(spark):
    s = 2**62
    row = spark.createDataFrame([(s, s)], "a long, n long").select(F.expr("(CAST(a AS DECIMAL(38,0)) * 2000000) div (CAST(a AS DECIMAL(38,0)) + n)").alias("x")).first()
    assert row["x"] == 2_000_000 * s // (2 * s)


# --- hard negatives


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 40), st.integers(1, 9), st.sampled_from([1, 2, 5, 160, 70_000, 2**31, 2**45, 2**62]), st.integers(0, 9))
def test_products_are_exact(m, n, dim, most, seed):
    rng = np.random.default_rng(seed)
    a, x = (rng.integers(-most, most + 1, (k, dim)) for k in (m, n))
    want = np.clip(a.astype(object) @ x.astype(object).T, hard_negatives.LOW, hard_negatives.HIGH)
    assert (hard_negatives.products(a, x).astype(object) == want).all()


def negatives_by_hand(rows, every, scale=256):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(scale * x) for x in v])
        best[i] = min(best.get(i, row), row)
    out = []
    for a, (label, x) in best.items():
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), i, other) for i, (other, y) in best.items() if i != a)
        for s, p, _ in [t for t in scores if t[2] == label][:5]:
            fit = [t for t in scores if t[2] != label and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


def vectors(seed):
    rng = random.Random(seed)
    some = [[rng.gauss(0.2, 0.3) for _ in range(6)] for _ in range(40)]
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), rng.choice(some) if rng.random() < 0.5 else [rng.gauss(0.2, 0.3) for _ in range(6)]) for i in range(400)]
    rows += [(None, 1, some[0]), (401, None, some[0]), (402, 1, None), (403, 2, [1.0, None]), (404, 2, [float("nan")] * 6), (405, 2, [float("inf")] * 6), (406, 2, []), (410, 1, some[0][:3]), (420, 3, some[1] + [0.5]), (10, 1, some[2]), (10, 1, some[2]), (20, 9, some[3]), (430, 77, some[4]), (431, 1, [0.0] * 6), (440, 1, [0.0] * 6)]
    return rows


@pytest.mark.parametrize("cell,block", [(16384, 16384), (30, 7)])
def test_hard_negatives_equal_brute_force(spark, cell, block):
    rows = vectors(5)
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("mine") for c in ("id", "x", "anchor", "number", "rank", "row")})
    got = hard_negatives.mine(table, F.col("vec_id") % 10 == 0, "vec_id", F.col("label"), F.col("embedding"), cell=cell, block=block)
    assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows, 10)


def test_hard_negatives_when_the_grid_is_dealt_over_many_tasks(spark):
    rows = vectors(7)
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # large tables aren't coalesced to one task
    try:
        got = hard_negatives.mine(table, F.col("vec_id") % 10 == 0, "vec_id", F.col("label"), F.col("embedding"), cell=30, block=7).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got)) == negatives_by_hand(rows, 10)


def test_wide_vectors_other_types_and_empty_tables(spark):
    rng = random.Random(6)
    rows = [(f"v{i:03d}", rng.choice("ab"), [rng.gauss(0, 1) * 10.0 ** rng.randint(0, 6) for _ in range(5)]) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id string, label string, embedding array<double>")
    got = hard_negatives.mine(table, F.col("vec_id").endswith("0"), "vec_id", F.col("label"), F.col("embedding")).collect()
    numbered = {v: i for i, (v, _, _) in enumerate(rows)}
    want = negatives_by_hand([(numbered[v], x, e) for v, x, e in rows], 10)
    assert sorted((numbered[r[0]], numbered[r[1]], r[2], numbered[r[3]], r[4], r[5]) for r in got) == want
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    for t in (none, spark.createDataFrame([(1, 1, [1.0])], none.schema)):
        assert hard_negatives.mine(t, F.col("vec_id") % 50 == 0, "vec_id", F.col("label"), F.col("embedding")).count() == 0


def test_queries_have_the_contracts_columns(spark, sf):
    made = queries.queries()
    assert dict(made["op11_packing"](spark, sf).dtypes) == {c: "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    assert dict(made["op13_hard_negatives"](spark, sf).dtypes) == {c: "bigint" for c in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")} | {"rank": "int"}
