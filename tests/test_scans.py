"""Scans of groups that span ranges, against what one pass in Python gives."""

import random

import pytest
from pyspark.sql import functions as F

from weir.operators import joins as J
from weir.operators import ranking as R
from weir.operators import scans as S

from .test_operators import rows


def series(seed, n=400):
    """One session has a third of the rows or more; some have one row; times repeat."""
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "b", f"s{i}", None]), rng.randint(0, 300), rng.choice([None, rng.randint(-5, 5)])) for i in range(n)]


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_running_values(spark, ranges):
    data = [(p, t, i, v) for i, (p, t, v) in enumerate(series(1))]
    df = spark.createDataFrame(data, "p string, t int, i int, v int").repartition(5)
    got = S.run_over(S.ranged(df, ["p"], ["t", "i"], ranges), ["p"], ["t", "i"], running={"total": F.col("v")}, before={"most": F.col("v")}, after={"least": F.col("v")})
    want = []
    for p in {x[0] for x in data}:
        own = sorted((x for x in data if x[0] == p), key=lambda x: x[1:3])
        for k, x in enumerate(own):
            seen = lambda some: [y[3] for y in some if y[3] is not None]
            want.append((*x, sum(seen(own[: k + 1])), max(seen(own[:k]), default=None), min(seen(own[k + 1 :]), default=None)))
    assert rows(got, "p", "t", "i", "v", "total", "most", "least") == sorted(want, key=repr)
    assert S.run_over(S.ranged(df.limit(0), ["p"], ["t"], ranges), ["p"], ["t"], running={"x": F.lit(1)}).count() == 0


def test_a_hot_group_is_shared_out(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("p"), F.col("id").alias("t"))
    sizes = [r["n"] for r in S.ranged(df, ["p"], ["t"], 16).groupBy(S.RANGE).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 12 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_parts(spark):
    data = [("a", i) for i in range(25)] + [("b", 1)]
    got = S.in_parts(spark.createDataFrame(data, "p string, t int").repartition(3), ["p"], ["t"], 10, ranges=4)
    assert rows(got, "p", "t", "part_no", "place") == sorted([("a", i, i // 10, i) for i in range(25)] + [("b", 1, 0, 0)], key=repr)


@pytest.mark.parametrize("ranges", [1, 9])
def test_quiet_points_and_slices(spark, ranges):
    rng = random.Random(4)
    flows = [(rng.choice(["hot", "hot", "x", "y"]), 10 * rng.randint(0, 200), f"u{i % 7}", "GET") for i in range(300)]
    actions = [(rng.choice(["hot", "x", "z"]), 10 * rng.randint(-2, 205), i) for i in range(60)]
    f = spark.createDataFrame(flows, "session string, t int, url string, method string").select("session", F.timestamp_seconds("t").alias("ts"), "url", "method")
    a = spark.createDataFrame(actions, "session string, t int, action_id int").select("session", F.timestamp_seconds("t").alias("start_ts"), "action_id")
    quiet = 20
    want = {}
    for s in {x[0] for x in flows}:
        own = sorted(x[1] for x in flows if x[0] == s)
        want[s] = next(t for k, t in enumerate(own) if k + 1 == len(own) or own[k + 1] - t >= quiet)
    assert rows(R.quiet_point(f, quiet, ranges=ranges).select("session", F.unix_timestamp("quiet_at"))) == sorted(want.items())
    pairs = []
    for s, start, i in actions:
        own = sorted((x for x in flows if x[0] == s and x[1] > start), key=lambda x: x[1])
        for k, x in enumerate(own):
            if k and x[1] - own[k - 1][1] >= quiet:
                break
            pairs.append((i, x[1], x[2]))
    got = J.slice_windows(a, f, quiet, ranges=ranges)
    assert rows(got.select("action_id", F.unix_timestamp("ts"), "url")) == sorted(pairs, key=repr)
    base = spark.createDataFrame([("u1", "GET")], "url string, method string")
    assert rows(J.slice_windows(a, f, quiet, base, ranges=ranges).select("action_id", F.unix_timestamp("ts"), "url")) == sorted([p for p in pairs if p[2] != "u1"], key=repr)


@pytest.mark.parametrize("ranges", [1, 9])
def test_forward_labels(spark, ranges):
    rng = random.Random(5)
    turns = [("hot" if i % 2 else f"c{i % 11}", i, rng.choice(["user", "assistant", "tool", None]), rng.choice([None, None, "x", "y"])) for i in range(300)]
    got = J.forward_label(spark.createDataFrame(turns, "conv_id string, turn int, role string, label string"), 2, ranges=ranges)
    want = []
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: t[1])
        for k, t in enumerate(own):
            if t[2] == "user":
                label = None
                for u in own[k + 1 : k + 3]:
                    if u[2] == "user":
                        break
                    if u[3] is not None:
                        label = u[3]
                        break
                want.append((*t, label))
    assert rows(got, "conv_id", "turn", "role", "label", "actual") == sorted(want, key=repr)
