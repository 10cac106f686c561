"""The pipeline's stages on awkward rows, clashing columns and empty tables, and what they keep of clean documents."""

import shutil

from pyspark.sql import functions as F

import corpus_pipeline

from .common import awkward, clashing, empty


def tables(spark, sf, tmp_path, docs):
    """A folder with docs as the documents, and the given labels and benchmark."""
    d = tmp_path / "tables"
    d.mkdir()
    docs.write.parquet(str(d / "documents.parquet"))
    for name in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{name}.parquet", d / f"{name}.parquet")
    return str(d)


def key(rows):
    return sorted((tuple(str(x) for x in r) for r in rows))


def test_stages_carry_clashing_columns(spark, sf, tmp_path):
    docs = clashing(awkward(spark)).withColumn("extra", F.create_map(F.lit("k"), F.lit("v")))
    d = tables(spark, sf, tmp_path, awkward(spark))
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, d)
        assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        now = spark.read.schema(out.schema).parquet(path)
        assert now.filter("score <> 'mine' OR pii <> 'mine' OR kept <> 'mine' OR row <> 'mine' OR extra['k'] <> 'v'").isEmpty(), name
        seen[name] = now.collect()
    # nothing here is toxic; repeated rows and equal texts go to one, what has no words or no id stays
    assert key(seen["toxicity"]) == key(docs.collect())
    left = seen["near_duplicates"]
    ids = [r["doc_id"] for r in left]
    assert ids.count(3) == 1 and 107 not in ids and ids.count(None) == 2 and {100, 101, 102, 103, 104, 105, 106} <= set(ids)
    assert key(seen["decontamination"]) == key(left)
    assert [r["text"] for r in seen["pii"] if r["doc_id"] == 100] == [None] and [r["text"] for r in seen["pii"] if r["doc_id"] == 101] == [""]
    last = corpus_pipeline.STAGES[-1][1](spark, now, d).collect()
    assert len(last) == len(left) and {r["n_tokens"] for r in last if r["doc_id"] in (100, 101)} == {0}
    assert corpus_pipeline.encode(spark, now.select("doc_id", "text"), d).columns == ["doc_id", "n_tokens", "ids"]


def test_stages_of_empty_tables(spark, sf, tmp_path):
    d = tables(spark, sf, tmp_path, empty(spark))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), d).count() == 0, name


def test_rows_that_share_an_id_leave_one_by_content(spark, sf):
    rows = [(7, f"text number {k} of one id with words of its own {k} {k * k}", "en", "s", k) for k in range(5)]
    kept = set()
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        out = corpus_pipeline.drop_near_duplicates(spark, df, sf).collect()
        assert len(out) == 1
        kept.add(out[0]["text"])
    assert len(kept) == 1
