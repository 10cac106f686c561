"""Streams give what batches give."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weir.operators import ranking as R
from weir.operators.decide import triage
from weir.sources import io as IO
from weir.streaming import ledgers as S

from .test_operators import RULES, rows

PAYLOADS = ['{"prompt":"run the pytests","session_id":"s"}', "", "[1]", "{nope", '{"hint":"a cli banner"}', '{"other":1}']


def test_observe_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join(json.dumps({"seq": i, "payload": p}) for i, p in enumerate(PAYLOADS)) + "\n")
    schema = "seq long, payload string"
    batch = S.observe(spark.read.schema(schema).json(str(src)), RULES)
    assert rows(batch, "seq", "error", "action") == [(0, None, "dispatch"), (1, "empty_stdin", None), (2, "bad_stdin_shape", None), (3, "bad_stdin_json", None), (4, None, "ask"), (5, None, "handoff")]
    q = S.observe_stream(spark.readStream.schema(schema).json(str(src)), RULES, str(tmp_path / "out"), str(tmp_path / "weak"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert rows(spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")), "seq", "error", "action") == rows(batch, "seq", "error", "action")
    assert rows(spark.read.parquet(str(tmp_path / "weak")), "seq") == [(0,), (4,), (5,)]


def test_rows_that_cant_be_decided_have_an_error_class(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    texts = ["run the pytests", "boom at once", "a cli banner", "another boom", "plain"]
    (src / "a.jsonl").write_text("\n".join(json.dumps({"seq": i, "payload": json.dumps({"prompt": t})}) for i, t in enumerate(texts)) + "\n")
    (src / "b.jsonl").write_text(json.dumps({"seq": 9, "payload": json.dumps({"prompt": "run the pytests"})}) + "\n")
    schema = "seq long, payload string"

    def decide(rows):
        out = triage(rows, RULES, None, id_col="seq", text="hint")
        return out.withColumn("action", F.when(F.contains("hint", F.lit("boom")), F.raise_error(F.lit("can't decide")).cast("string")).otherwise(F.col("action")))

    q = S.observe_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)), RULES, str(tmp_path / "out"), str(tmp_path / "weak"), str(tmp_path / "ck"), decide=decide)
    q.awaitTermination(240)
    assert q.exception() is None
    got = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(str(tmp_path / "out"))
    assert rows(got, "seq", "error", "action") == [(0, None, "dispatch"), (1, "decide_failed", None), (2, None, "ask"), (3, "decide_failed", None), (4, None, "handoff"), (9, None, "dispatch")]
    assert rows(spark.read.parquet(str(tmp_path / "weak")), "seq") == [(0,), (2,), (4,), (9,)]
    # a decision without an action is one that failed
    none = S.observe(spark.read.schema(schema).json(str(src)), RULES, decide=lambda r: triage(r, RULES, None, id_col="seq", text="hint").withColumn("action", F.lit(None).cast("string")))
    assert rows(none, "error") == [("decide_failed",)] * 6


def test_new_high_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    pts = [("a", i, i, float(v)) for i, v in enumerate([3, 9, 2, 10])] + [("b", 1, 1, 4.0)]
    pts += [("c", t, t, v) for t, v in ((5, 1.0), (1, 9.0), (3, 2.0))] + [("d", k, 0, float(-k)) for k in range(20)]
    # the files are read in an order that isn't that of time
    for k, part in enumerate((pts[3:], pts[:2], pts[2:3])):
        (src / f"{k}.jsonl").write_text("\n".join(json.dumps(dict(zip(("series", "ts", "seq", "value"), p, strict=True))) for p in part) + "\n")
    schema = "series string, ts long, seq long, value double"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = S.new_high_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)), 8)
    out = []
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend((n, *r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r[1]: r[1:] for r in sorted(out)}
    batch = R.new_high(spark.createDataFrame(pts, schema), spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "series string"), 8)
    assert sorted((k, *v[1:]) for k, v in last.items()) == rows(batch, "series", "status", "latest", "prev_max", "points")


def test_dedupe_stream_and_redacted_events(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:0{i}:00Z", "text": t, "hint": "h", "work_unit_id": "u", "duration_ms": -1}) for i, t in enumerate(["A b", "a  B", "c"])) + "\n")
    schema = "ts timestamp, text string, hint string, work_unit_id string, duration_ms double"
    stream = S.event_stream(S.dedupe_stream(spark.readStream.schema(schema).json(str(src)), "text"))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert "hint" not in got.columns and got.count() == 2 and got.filter("duration_ms <> 0").count() == 0


def test_sessions(spark):
    m = spark.createDataFrame([("c", "2024-01-01 00:00:01", "in", "a"), ("c", "2024-01-01 00:00:00", "out", "b"), ("c", "2024-01-01 05:00:00", "in", "z")], "session string, ts string, direction string, text string").withColumn("ts", F.to_timestamp("ts"))
    assert [x["text"] for x in S.ws_sessions(m).first()["messages"]] == ["b", "a", "z"]
    assert S.ws_sessions(m, gap="1 hour").count() == 2
    assert rows(S.ws_sessions(m, most=2), "session", "part_no", F.size("messages")) == [("c", 0, 2), ("c", 1, 1)]


def test_session_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rng = random.Random(2)
    said = [(rng.choice(["hot", "hot", "x", "y"]), i, rng.choice(["in", "out", None]), rng.choice(["a", "é", "", None])) for i in range(90)]
    # three batches of thirty minutes each, out of order by up to five minutes; the connections go over all of them
    order = sorted(said, key=lambda r: r[1] + rng.randint(0, 5))
    shown = [{"session": s, "ts": f"2024-01-01T{i // 60:02}:{i % 60:02}:00.000Z", "direction": d, "text": t} for s, i, d, t in order]
    for k, part in enumerate([shown[:30], shown[30:60], shown[60:], [{"session": "end", "ts": "2024-02-01T00:00:00.000Z", "direction": "", "text": ""}]]):
        (src / f"{k}.jsonl").write_text("\n".join(map(json.dumps, part)) + "\n")
        os.utime(src / f"{k}.jsonl", (1_700_000_000 + k, 1_700_000_000 + k))
    schema = "session string, ts timestamp, direction string, text string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = S.ws_session_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)), delay="6 minutes", quiet_s=7200, most=10)
    got = []
    q = stream.writeStream.foreachBatch(lambda b, n: got.extend((n, *r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None and len({g[0] for g in got if g[1] == "hot"}) > 1  # handed on in parts, before the end
    batch = S.ws_sessions(spark.read.schema(schema).json(str(src)).filter("session <> 'end'"), most=10)
    want = [(r["session"], r["part_no"], m["ts"], m["direction"], m["text"]) for r in batch.collect() for m in r["messages"]]
    have = [(g[1], g[2], g[4], g[5], g[6]) for g in sorted(got, key=lambda g: (g[1], g[3]))]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert [h for h in have if h[0] == "hot"] == [w for w in sorted(want, key=lambda w: (w[0], w[1])) if w[0] == "hot"]


def test_failures_are_told_by_kind(spark):
    def failed(run):
        try:
            run()
        except Exception as error:
            return S.failure_kind(error)

    one = spark.range(3)

    def python(error):
        def run(batches):
            for b in batches:
                raise error
                yield b

        return lambda: one.mapInPandas(run, "id long").collect()

    assert failed(lambda: one.select(F.raise_error(F.lit("no"))).collect()) == "decision"
    assert failed(lambda: one.selectExpr("1 div (id - 1)").collect()) == "decision"
    assert failed(lambda: one.selectExpr("cast(concat('x', id) as int)").collect()) == "decision"
    assert failed(python(ValueError("bad row"))) == "decision"
    assert failed(python(OSError("No space left on device"))) == "environment"
    assert failed(python(ConnectionResetError("gone"))) == "environment"
    assert failed(lambda: spark.read.schema("a int").parquet("/nowhere/at/all").collect()) == "environment"
    assert S.failure_kind(OSError("x")) == "environment" and S.failure_kind(RuntimeError("executor lost")) == "environment"


def test_environment_failures_are_tried_again_then_stop_the_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    texts = ["run the pytests", "boom at once", "plain"]
    (src / "a.jsonl").write_text("\n".join(json.dumps({"seq": i, "payload": json.dumps({"prompt": t})}) for i, t in enumerate(texts)) + "\n")
    schema, left = "seq long, payload string", [1]

    def decide(rows):
        if left[0]:
            left[0] -= 1
            raise OSError("a disk went away")
        out = triage(rows, RULES, None, id_col="seq", text="hint")
        return out.withColumn("action", F.when(F.contains("hint", F.lit("boom")), F.raise_error(F.lit("can't decide")).cast("string")).otherwise(F.col("action")))

    def start(**more):
        raw = spark.readStream.schema(schema).json(str(src))
        return S.observe_stream(raw, RULES, str(tmp_path / "out"), str(tmp_path / "weak"), str(tmp_path / "ck"), decide=decide, attempts_path=str(tmp_path / "tries"), limits=S.Quarantine(retries=1, wait_s=0), **more)

    left[0] = 99
    q = start()
    with pytest.raises(Exception, match="a disk went away"):
        q.awaitTermination(240)
    assert left[0] == 97  # one more try, then the batch stopped
    left[0] = 1  # once more, at the start; the same batch is decided again
    q = start()
    q.awaitTermination(240)
    assert q.exception() is None
    got = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(str(tmp_path / "out"))
    assert rows(got, "seq", "error", "action") == [(0, None, "dispatch"), (1, "decide_failed", None), (2, None, "handoff")]
    tries = IO.read_ledger(spark, str(tmp_path / "tries"), "batch long, part string, attempt int, kind string, error string".replace("batch", "number"))
    kinds = [r["kind"] for r in tries.collect()]
    assert kinds.count("environment") == 3 and kinds.count("decision") >= 3 and kinds.count("done") >= 1
    # where everything fails, the rules are at fault, and nothing is written off
    always = lambda rows: triage(rows, RULES, None, id_col="seq", text="hint").withColumn("action", F.raise_error(F.lit("never")).cast("string"))
    raw = spark.readStream.schema(schema).json(str(src))
    q = S.observe_stream(raw, RULES, str(tmp_path / "o2"), str(tmp_path / "w2"), str(tmp_path / "c2"), decide=always, limits=S.Quarantine(most_attempts=4))
    with pytest.raises(Exception, match="attempts at one batch"):
        q.awaitTermination(240)


class _Kept:
    """State of one group, counting how often it is asked."""

    def __init__(self, asked):
        self.asked, self.value, self.map, self.timers = asked, None, {}, set()

    def __getattribute__(self, name):
        get = object.__getattribute__
        if name not in ("asked", "value", "map", "timers"):
            get(self, "asked").append(name)
        return get(self, name)

    def exists(self):
        return bool(self.value or self.map)

    def get(self):
        return self.value

    def put(self, rows):
        self.value = list(rows)

    def update(self, row):
        self.value = row

    def appendValue(self, row):
        self.value = [*(self.value or []), row]

    def clear(self):
        self.value = None

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, row):
        self.map[key] = row

    def removeKey(self, key):
        del self.map[key]

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_connections_share_the_state_of_their_group():
    asked = []
    handle, held, live, ended = (_Kept(asked) for _ in range(4))
    handle.getListState, handle.getValueState, handle.getMapState = (lambda *_: held), (lambda *_: live), (lambda *_: ended)
    connections = S._Connections(2, 1000)
    connections.init(handle)

    class Mark:
        at = 0
        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.at

    def sent(*messages):
        part = pd.DataFrame(messages, columns=["session", "at", "direction", "text"])
        part["ts"] = pd.to_datetime(part.pop("at"), unit="s")
        return [tuple(r) for out in connections.handleInputRows((0,), iter([part]), mark) for r in out[["session", "part_no", "place", "text"]].itertuples(index=False)]

    def ends():
        return sorted((tuple(r) for out in connections.handleExpiredTimer((0,), mark, mark) for r in out[["session", "part_no", "place", "text"]].itertuples(index=False)), key=repr)

    mark = Mark()
    asked.clear()
    assert sent(*((f"s{i}", t, "in", str(t)) for i in range(500) for t in (3, 1))) == []
    assert len(asked) < 20
    mark.at = 2500
    assert sent((None, 2, None, "n"), ("s7", 2, "in", "2")) == [("s7", 0, 0, "1"), ("s7", 0, 1, "2")]
    mark.at = 3500
    assert ends() == [(None, 0, 0, "n")]  # due at 3 s; the others at 4 s
    mark.at = 4000
    got = ends()
    assert len(got) == 999 and ("s7", 1, 2, "3") in got and ("s8", 0, 0, "1") in got and ("s8", 0, 1, "3") in got and not live.value and not held.value
    assert sent(("s7", 9, "in", "9"), ("new", 9, "in", "9")) == []
    mark.at = 11000
    assert ends() == [("new", 0, 0, "9"), ("s7", 1, 3, "9")]
