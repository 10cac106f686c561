"""Snapshots: what differs is found, and only its ranges are read."""

import random

from pyspark.sql import functions as F

from weir.operators import snapshots as S

from .test_operators import rows

SCHEMA = "k int, s string, v double"


def table(seed, n=300):
    rng = random.Random(seed)
    return [(rng.randint(0, 200) if rng.random() < 0.95 else None, rng.choice(["a", "b", None]), rng.choice([1.0, None, 2.5])) for _ in range(n)]


def test_differences_since_a_snapshot(spark, tmp_path):
    data = table(1)
    base = spark.createDataFrame(data, SCHEMA)
    path = str(tmp_path / "s")
    S.write_snapshot(base, path, ["k"], 32)
    assert S.changed_ranges(base.select("v", "k", "s").repartition(7), path, ["k"]) == [] and S.diff_snapshot(base, path, ["k"]).count() == 0
    # nulls and repeated rows count; what changes places between two columns is a change
    for change in (lambda d: d[1:], lambda d: [*d, d[0]], lambda d: [*d, (999, "a", 1.0)], lambda d: [(k, "b" if k == d[5][0] else s, v) for k, s, v in d], lambda d: [(k, s, None if i == 7 else v) for i, (k, s, v) in enumerate(d)], lambda d: []):
        new = change(data)
        by = lambda d: {k: sorted((x[1:] for x in d if x[0] == k), key=repr) for k in {x[0] for x in d}}
        then, now = by(data), by(new)
        want = [(k, "removed" if k not in now else "added" if k not in then else "changed") for k in then.keys() | now.keys() if then.get(k) != now.get(k)]
        assert rows(S.diff_snapshot(spark.createDataFrame(new, SCHEMA), path, ["k"]), "k", "change") == sorted(want, key=repr)


def test_one_row_costs_one_range(spark, tmp_path):
    base = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    path = str(tmp_path / "s")
    S.write_snapshot(base, path, ["k"], 64)
    now = base.withColumn("v", F.when(F.col("k") == 77, -1).otherwise(F.col("v")))
    assert len(S.changed_ranges(now, path, ["k"])) == 1
    diff = S.diff_snapshot(now, path, ["k"])
    assert rows(diff) == [(77, "changed")]
    assert "PartitionFilters: [isnotnull(_range" in diff._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [_range" in diff._jdf.queryExecution().executedPlan().toString()


def test_empty_snapshots(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    S.write_snapshot(none, str(tmp_path / "s"), ["k"])
    assert S.diff_snapshot(none, str(tmp_path / "s"), ["k"]).count() == 0
    assert rows(S.diff_snapshot(spark.createDataFrame([(1, "a", 1.0)], SCHEMA), str(tmp_path / "s"), ["k"])) == [(1, "added")]


def test_differences_are_dealt_over_as_many_tasks_as_rows_need(spark, tmp_path, monkeypatch):
    from weir.operators import sets

    monkeypatch.setattr(sets, "ROWS_A_TASK", 50)
    base = spark.range(1000).selectExpr("id", "if(id % 9 = 0, null, id % 7) AS v")
    now = base.filter("id <> 4").unionByName(spark.sql("SELECT -1L AS id, 1L AS v UNION ALL SELECT 7L, 0L UNION ALL SELECT NULL, NULL"))
    facts = sets.fact_diff(now, base, ["id", "v"])
    assert facts.rdd.getNumPartitions() >= 40
    assert sorted(map(tuple, facts.collect()), key=repr) == sorted([(4, 4, "removed"), (-1, 1, "added"), (None, None, "added")], key=repr)
    S.write_snapshot(base, f"{tmp_path}/s", ["id"], 8)
    found = S.diff_snapshot(now.filter("id <> 5 OR id IS NULL").unionByName(spark.sql("SELECT 5L AS id, 6L AS v")), f"{tmp_path}/s", ["id"])
    assert found.rdd.getNumPartitions() >= 10
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(4, "removed"), (-1, "added"), (7, "changed"), (5, "changed"), (None, "added")], key=repr)
