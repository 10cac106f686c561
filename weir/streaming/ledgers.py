"""Streaming forms of the ledgers: observed prompts, weak decisions, redacted events, new highs, dedupe, sessions."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException, PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import norm_key, pick_field
from ..operators.decide import RuleSet, triage
from ..operators.filters import weak_decisions
from ..operators.scans import RANGE, in_parts, ranged, run_over
from ..sources.io import append_events, redact_event

HINTS = ("prompt", "hint", "user_prompt", "message", "text", "input")


Decide = Callable[[DataFrame], DataFrame]

# SQL states of errors that rows cause (data exceptions, errors that a query raises, failing functions).
DATA_STATES = r"SQLSTATE: (?:22\w{3}|21000|P0001|39000)"
#: Python errors that a worker reports and that aren't the rows' fault.
MACHINE_ERRORS = r"^\s*(?:\w+\.)*(?:\w*IOError|OSError|\w*FileNotFound\w*|PermissionError|BlockingIOError|Connection\w*Error|BrokenPipeError|TimeoutError|MemoryError|EOFError)\b"


@dataclass(frozen=True)
class Quarantine:
    retries: int = 2  # times that a part is tried again after a failure that isn't its rows' fault
    most_attempts: int = 400  # of a batch; with more, its rules are at fault, and the stream stops
    wait_s: float = 1.0  # before another try


class Stopped(RuntimeError):
    """A batch that can't be finished: it isn't committed, and is decided again as a whole when the stream goes on."""


def failure_kind(error: BaseException) -> str:
    """decision (the rows made the query fail) or environment (files, memory, executors, the network, the driver)."""
    if isinstance(error, (OSError, MemoryError)):
        return "environment"
    text = str(error)
    state = error.getSqlState() if isinstance(error, PySparkException) and error.getSqlState() else ""
    if isinstance(error, PythonException) or "Traceback (most recent call last)" in text:
        last = [line for line in text.split("Traceback (most recent call last)")[-1].splitlines() if re.match(r"[\w.]+(?:Error|Exception)\b", line)]
        return "environment" if any(re.match(MACHINE_ERRORS, line) for line in last) else "decision"
    return "decision" if re.search(DATA_STATES, f"SQLSTATE: {state} {text}") else "environment"


def read_payloads(raw: DataFrame, payload: str = "payload", most: int = 4000) -> DataFrame:
    """raw with error (empty_stdin, bad_stdin_json, bad_stdin_shape or null), hint, hint_len, bytes and session, without the payload."""
    text = F.trim(F.coalesce(F.col(payload), F.lit("")))
    parsed = F.try_parse_json(F.nullif(text, F.lit("")))
    hint = F.coalesce(pick_field(F.col(payload), HINTS), F.lit(""))
    error = F.when(text == "", "empty_stdin").when(parsed.isNull(), "bad_stdin_json").when(~F.startswith(text, F.lit("{")), "bad_stdin_shape")
    rows = raw.withColumns({"error": error, "hint": F.when(error.isNull(), F.left(hint, F.lit(most))), "hint_len": F.when(error.isNull(), F.length(hint)), "bytes": F.octet_length(F.col(payload)), "session": F.when(error.isNull(), pick_field(F.col(payload), ("session_id", "sessionId", "session")))})
    return rows.drop(payload)


def _decided(rows: DataFrame, decide: Decide) -> DataFrame:
    """rows with a decision where they could be read; one without an action is decide_failed."""
    out = decide(rows).withColumn("error", F.coalesce("error", F.when(F.col("action").isNull(), "decide_failed")))
    for c in ("mode", "domain", "confidence", "action"):
        out = out.withColumn(c, F.when(F.col("error").isNull(), F.col(c)))
    return out.drop("_active")


def observe(raw: DataFrame, rules: RuleSet, payload: str = "payload", most: int = 4000, decide: Decide | None = None) -> DataFrame:
    """Decided rows of raw payloads; batch or stream. What can't be read has an error class (empty_stdin, bad_stdin_json,
    bad_stdin_shape) and no decision. Needs a column `seq` that tells rows apart. decide: another way than triage."""
    return _decided(read_payloads(raw, payload, most), decide or (lambda rows: triage(rows, rules, None, id_col="seq", text="hint")))


class _Batch:
    """Writes the decided rows of a batch. A part whose decision fails is halved by a hash of `seq` until the rows that fail stand
    alone; a row is decide_failed once it has failed twice by itself. Other failures are tried again, then stop the batch."""

    def __init__(self, decide: Decide, path: str, limits: Quarantine):
        self.decide, self.path, self.limits = decide, path, limits
        self.attempts: list[tuple] = []  # part, attempt, kind (done, decision, environment), error

    def _try(self, rows: DataFrame, part: str) -> str:
        if len(self.attempts) >= self.limits.most_attempts:
            raise Stopped(f"{len(self.attempts)} attempts at one batch")
        kind, text = "done", None
        try:
            _decided(rows, self.decide).write.mode("overwrite").parquet(f"{self.path}/{part}")
        except Exception as error:
            kind, text = failure_kind(error), f"{type(error).__name__}: {error}"[:500]
        self.attempts.append((part, 1 + sum(a[0] == part for a in self.attempts), kind, text))
        return kind

    def _tried(self, rows: DataFrame, part: str) -> str:
        """done or decision; a failure of another kind is tried again."""
        for left in range(self.limits.retries, -1, -1):
            kind = self._try(rows, part)
            if kind != "environment":
                return kind
            if left:
                time.sleep(self.limits.wait_s)
        raise Stopped(f"part {part}: {self.attempts[-1][3]}")

    def write(self, rows: DataFrame, part: str = "part", depth: int = 0) -> list[str]:
        """The parts written."""
        if self._tried(rows, part) == "done":
            return [part]
        if rows.select("seq").distinct().limit(2).count() > 1:
            half = F.pmod(F.xxhash64(F.col("seq"), F.lit(depth)), F.lit(2))
            return [p for k in (0, 1) for p in self.write(rows.filter(half == k), f"{part}-{k}", depth + 1)]
        if self._tried(rows, part) == "decision":
            lost = F.lit(None).cast("string")
            rows.withColumns({"error": F.coalesce("error", F.lit("decide_failed")), "mode": lost, "domain": lost, "confidence": lost, "action": lost}).write.mode("overwrite").parquet(f"{self.path}/{part}")
        return [part]


def observe_stream(raw: DataFrame, rules: RuleSet, path: str, weak_path: str, checkpoint: str, decide: Decide | None = None, attempts_path: str | None = None, limits: Quarantine = Quarantine(), **options) -> StreamingQuery:
    """Writes decided rows to one ledger and the weak ones to another, in one query; each batch is written once by its number.

    Rows that can't be read or decided have an error class and don't stop the stream; a failure of files, memory, executors or the like does (see
    Quarantine), with nothing lost: its batch is decided again when the stream is started again. attempts_path: a ledger of the attempts at
    batches that didn't go through at once (batch, part, attempt, kind, error), by io.append_events.
    """
    decide = decide or (lambda rows: triage(rows, rules, None, id_col="seq", text="hint"))

    def both(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        # a part of the batch has a folder of its own, so that a repeated batch writes over what it wrote
        run = _Batch(decide, f"{path}/batch={number}", limits)
        try:
            parts = run.write(batch)
        finally:
            batch.unpersist()
            if attempts_path and any(kind != "done" for _, _, kind, _ in run.attempts):
                told = spark.createDataFrame([(number, *a) for a in run.attempts], "batch long, part string, attempt int, kind string, error string")
                append_events(told.withColumn("timestamp", F.current_timestamp()), attempts_path, f"{number}-{uuid.uuid4().hex}")
        decided = spark.read.option("mergeSchema", "true").parquet(*(f"{path}/batch={number}/{p}" for p in parts))
        weak_decisions(decided.filter("error IS NULL")).write.mode("overwrite").parquet(f"{weak_path}/batch={number}")

    return read_payloads(raw).writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).options(**options).start()


def event_stream(events: DataFrame, counts: Sequence[str] = ()) -> DataFrame:
    """Redacted events; batch or stream."""
    return redact_event(events, counts=counts)


class _NewHigh(StatefulProcessor):
    """Keeps the last n points of a series by (ts, seq), in whatever order they arrive."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", "ts long, seq long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail = [tuple(r) for r in self.tail.get()] if self.tail.exists() else []
        for part in rows:  # n points are held, however many a batch has
            new = zip(part["ts"].tolist(), part["seq"].tolist(), part["value"].astype(float).tolist(), strict=True)
            tail = nlargest(self.n, [*tail, *new], key=lambda p: p[:2])
        tail.sort(key=lambda p: p[:2])
        self.tail.put(tail)
        *before, latest = [p[2] for p in tail]
        status = "baseline" if not before else "new-high" if latest > max(before) else "flat"
        yield pd.DataFrame({"series": [key[0]], "status": [status], "latest": [latest], "prev_max": [max(before) if before else None], "points": [len(tail)]})

    def close(self) -> None:
        pass


def new_high_stream(points: DataFrame, n: int = 8) -> DataFrame:
    """(series, status, latest, prev_max, points) for each series of a batch, over its last n points by (ts, seq), both of type
    long, also where they arrive out of order; points: (series, ts, seq, value)."""
    return points.groupBy("series").transformWithStateInPandas(_NewHigh(n), "series string, status string, latest double, prev_max double, points long", "update", "none")


def dedupe_stream(df: DataFrame, text: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each normalised text within the watermark."""
    return df.withColumn("_key", norm_key(F.col(text))).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def ws_sessions(messages: DataFrame, session: str = "session", ts: str = "ts", direction: str = "direction", text: str = "text", gap: str | None = None, most: int = 1000) -> DataFrame:
    """(session, part_no, messages): the messages of each connection in order of time, in parts of `most`, so that no row or task
    holds more however long a connection is. With a gap, connections are cut into sessions (from, to) first."""
    keys = [session]
    if gap is not None:
        quiet = F.expr(f"CAST(INTERVAL {gap} AS INTERVAL SECOND)")
        near = run_over(ranged(messages, [session], [ts]), [session], [ts], before={"_prev": F.col(ts)})
        cut = run_over(near, [session], [ts], running={"_no": F.when(F.col("_prev").isNull() | (F.col(ts) >= F.col("_prev") + quiet), 1)})
        spans = cut.groupBy(session, "_no").agg(F.min(ts).alias("from"), (F.max(ts) + quiet).alias("to"))
        messages, keys = cut.drop("_prev", RANGE).join(spans, [session, "_no"]), [session, "from", "to"]
    rows = in_parts(messages, keys, [ts, direction, text], most)
    parts = rows.groupBy(*keys, "part_no").agg(F.array_sort(F.collect_list(F.struct("place", ts, direction, text))).alias("_m"))
    return parts.withColumn("messages", F.transform("_m", lambda m: F.struct(m[ts].alias(ts), m[direction].alias(direction), m[text].alias(text)))).drop("_m")


MOST_ROWS = 10_000  # messages that are kept or handed on as one


def _packed(rows: pa.Table) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(row: tuple) -> pa.Table:
    return pa.ipc.open_stream(bytes(row[0])).read_all()


class _Connections(StatefulProcessor):
    """Holds the messages of a group of connections until the watermark has passed them; hands them on in order, in parts of `most`, and
    all that is left of a connection once nothing has come for `quiet_ms`.

    State is asked once a group and batch, not once a connection or message: messages are kept packed, and so are the counts of live
    connections. What was given of connections that ended is kept by connection, and asked for only when one comes again.
    """

    COUNTS = pa.schema([("session", pa.string()), *((c, pa.int64()) for c in ("held", "given", "last", "first"))])

    def __init__(self, most: int, quiet_ms: int):
        self.most, self.quiet_ms = most, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.live = handle.getValueState("live", "rows binary")
        self.ended = handle.getMapState("ended", "session string", "given long")

    def _counts(self) -> dict[str | None, list[int]]:
        """[held, given, last, first]: messages held and given, the last time seen, the first one held."""
        if not self.live.exists():
            return {}
        name, *counts = _unpacked(self.live.get()).to_pydict().values()
        return dict(zip(name, map(list, zip(*counts, strict=True)), strict=True))

    def _keep(self, counts: dict, gone: int = -1) -> None:
        if counts:
            columns = [list(counts), *map(list, zip(*counts.values(), strict=True))]
            self.live.update(_packed(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.COUNTS, strict=True)], schema=self.COUNTS)))
        else:
            self.live.clear()
        due = min((last for _, _, last, _ in counts.values()), default=None)
        timer = None if due is None else due // 1000 + self.quiet_ms
        for old in list(self.handle.listTimers()):
            if old not in (timer, gone):
                self.handle.deleteTimer(old)
        if timer is not None:
            self.handle.registerTimer(timer)

    def _give(self, counts: dict, passed: int, over: Collection = ()) -> Iterator[pd.DataFrame]:
        """Hands on full parts of what is not after `passed`, and all of the connections that are over."""
        rows = pa.concat_tables(map(_unpacked, self.held.get()))
        # as Spark sorts: nulls first, texts by their bytes
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("session", "ts", "direction", "text")], null_placement="at_start"))
        coded = rows["session"].combine_chunks().dictionary_encode("encode")
        names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        starts = np.flatnonzero(np.diff(which, prepend=-1))
        sizes, at = np.diff(starts, append=len(which)), rows["ts"].to_numpy()
        ready = np.add.reduceat((at <= passed).astype(np.int64), starts) // self.most * self.most
        ready = np.where([name in over for name in names], sizes, ready)
        within = np.arange(len(which)) - np.repeat(starts, sizes)
        give = within < np.repeat(ready, sizes)
        place = (within + np.repeat([counts[name][1] for name in names], sizes))[give]
        for name, start, size, n in zip(names, starts.tolist(), sizes.tolist(), ready.tolist(), strict=True):
            c = counts[name]
            c[0], c[1], c[3] = c[0] - n, c[1] + n, int(at[start + n]) if n < size else FAR
        if give.any():
            rest = rows.filter(pa.array(~give)).combine_chunks()
            self.held.clear()
            if rest.num_rows:
                self.held.put([_packed(rest.slice(i, MOST_ROWS)) for i in range(0, rest.num_rows, MOST_ROWS)])
        out = rows.filter(pa.array(give))
        for i in range(0, out.num_rows, MOST_ROWS):
            part, p = out.slice(i, MOST_ROWS).to_pandas(), place[i : i + MOST_ROWS]
            yield pd.DataFrame({"session": part["session"], "part_no": p // self.most, "place": p, "ts": pd.to_datetime(part["ts"], unit="us"), "direction": part["direction"], "text": part["text"]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts, again = self._counts(), self.ended.exists()
        for part in rows:
            texts = {c: pa.array(part[c], pa.string(), from_pandas=True) for c in ("session", "direction", "text")}
            new = pa.table({"session": texts["session"], "ts": part["ts"].astype("datetime64[us]").astype("int64").to_numpy(), "direction": texts["direction"], "text": texts["text"]})
            self.held.appendValue(_packed(new))
            found = new.group_by("session").aggregate([("ts", "count"), ("ts", "max"), ("ts", "min")])
            for name, n, last, first in zip(*(found[c].to_pylist() for c in ("session", "ts_count", "ts_max", "ts_min")), strict=True):
                c = counts.get(name)
                if c is None:
                    before = self.ended.getValue((name,)) if again else None
                    if before is not None:
                        self.ended.removeKey((name,))
                    c = counts[name] = [0, before[0] if before else 0, 0, FAR]
                c[0], c[2], c[3] = c[0] + n, max(c[2], last), min(c[3], first)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if any(held >= self.most and first <= passed for held, _, _, first in counts.values()):
            yield from self._give(counts, passed)
        self._keep(counts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        counts, timer = self._counts(), expiredTimerInfo.getExpiryTimeInMs()
        now = max(timer, timerValues.getCurrentWatermarkInMs() - 1)
        over = {name for name, (_, _, last, _) in counts.items() if last // 1000 + self.quiet_ms <= now}
        if any(counts[name][0] for name in over):
            yield from self._give(counts, -FAR, over)
        for name in over:
            self.ended.updateValue((name,), (counts.pop(name)[1],))
        self._keep(counts, timer)

    def close(self) -> None:
        pass


FAR = 2**63 - 1  # after any time


def ws_session_stream(messages: DataFrame, session: str = "session", ts: str = "ts", direction: str = "direction", text: str = "text", delay: str = "10 minutes", quiet_s: float = 3600, most: int = 1000, groups: int = 1024) -> DataFrame:
    """(session, part_no, place, ts, direction, text): ws_sessions as a stream, a row for each message, in order within a part.

    A message may come `delay` late; a connection ends when nothing has come for quiet_s. What it holds is given on once the
    watermark has passed it: in full parts of `most`, and the rest at its end, so that parts are those of ws_sessions. Sessions
    are strings, dealt by their hash to groups that share their state; a task holds the waiting messages of one group at a time. Needs the RocksDB state store.
    """
    rows = messages.select(F.col(session).cast("string").alias("session"), F.col(ts).alias("ts"), F.col(direction).alias("direction"), F.col(text).alias("text")).withWatermark("ts", delay)
    out = "session string, part_no long, place long, ts timestamp, direction string, text string"
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("session"), F.lit(groups)).cast("int"))
    return dealt.groupBy("_group").transformWithStateInPandas(_Connections(most, int(quiet_s * 1000)), out, "append", "eventTime")
