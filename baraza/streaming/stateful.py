"""Keyed stateful streams that run the very folds of the batch guards.

Keys are dealt by hash into a fixed number of buckets, and a bucket's rows and states go through one call: a call of the state server for
every key of every micro-batch would take far longer than the folds.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from baraza import fixed_values as fv
from baraza.functions.text import is_report_keyword
from baraza.operators.guards import ReportSpacing, SlidingWindow, micros
from baraza.operators.sequential import Fold
from baraza.streaming.running import use_rocksdb


BUCKET, BUCKETS = "state_bucket", 128


def _bucketed(stream: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Add the bucket of a row's key: the state of a bucket's keys is read and written together, not key by key."""
    return stream.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _listed(column: pd.Series) -> list:
    """A column's values, null as None."""
    return column.astype(object).where(column.notna(), None).tolist()


def _of_key(column: pd.Series, kind: T.DataType) -> list:
    """A key column's values; beside a null pandas holds whole numbers as floats."""
    whole = isinstance(kind, T.IntegralType)
    return [int(v) if whole and v is not None else v for v in _listed(column)]


class FoldProcessor(StatefulProcessor):
    """Feeds the rows of a bucket's keys in a micro-batch, in order, to a fold whose state for a key is a list of whole numbers.

    With ``expire_us`` an event-time timer, set to the bucket's first key to end, drops the state of keys whose window has passed.
    """

    def __init__(self, fold: Fold, keys: list[T.StructField], order: list[str], columns: list[str], expire_us: int | None = None):
        self.fold, self.keys, self.order, self.columns, self.expire_us = fold, keys, order, columns, expire_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", T.StructType([*self.keys, T.StructField("v", T.LongType())]))

    def _read(self) -> dict[tuple, list[int]]:
        held = {}
        for row in self.kept.get():
            held.setdefault(tuple(row[:-1]), []).append(row[-1])
        return held

    def _write(self, held: dict[tuple, list[int]], timerValues, fired: int | None = None) -> None:
        if self.expire_us is not None:
            now = timerValues.getCurrentWatermarkInMs()
            held = {k: v for k, v in held.items() if v and self._end(v) > now}
            first = min((self._end(v) for v in held.values()), default=None)
            timers = list(self.handle.listTimers())
            for old in timers:
                if old not in (first, fired):
                    self.handle.deleteTimer(old)
            if first is not None and first not in timers:
                self.handle.registerTimer(first)
        rows = [(*k, int(v)) for k, values in held.items() for v in values]
        if rows:
            self.kept.put(rows)
        else:
            self.kept.clear()

    def _end(self, kept: list[int]) -> int:
        return (int(kept[-1]) + self.expire_us) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        held, states, results = self._read(), {}, []
        owners = zip(*(_of_key(frame[k.name], k.dataType) for k in self.keys))
        for owner, *values in zip(owners, *(_listed(frame[c]) for c in self.fold.inputs)):
            if owner not in states:
                states[owner] = self.fold.start(held.get(owner))
            results.append(self.fold.step(states[owner], *values))
        held.update((owner, list(self.fold.carry(state))) for owner, state in states.items())
        self._write(held, timerValues)
        for i, (name, kind) in enumerate(self.fold.outputs):
            frame[name] = pd.Series([r[i] for r in results], index=frame.index,
                                    dtype="Int64" if isinstance(kind, T.LongType) else None)
        yield frame[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._write(self._read(), timerValues, expiredTimerInfo.getExpiryTimeInMs())
        return iter([])

    def close(self) -> None:
        pass


def stream_fold(stream: DataFrame, keys: list[str], order: list[str], fold: Fold, *, expire_us: int | None = None,
                buckets: int = BUCKETS) -> DataFrame:
    """``sequential_scan`` for a stream; rows of a key are taken in ``order`` within each micro-batch.

    ``buckets`` must stay the same for a checkpoint.
    """
    use_rocksdb(stream.sparkSession)
    schema = T.StructType(stream.schema.fields + [T.StructField(n, t) for n, t in fold.outputs])
    held = [T.StructField(k, stream.schema[k].dataType) for k in keys]
    return _bucketed(stream, keys, buckets).groupBy(BUCKET).transformWithStateInPandas(
        FoldProcessor(fold, held, order, schema.fieldNames(), expire_us), schema, "Append",
        "EventTime" if expire_us is not None else "None")


def stream_rate_limit(events: DataFrame, keys: list[str], ts: str, order: str, *, limit: int = fv.RATE_LIMIT,
                      window_seconds: int = fv.RATE_WINDOW_SECONDS, lateness: str = "1 hour",
                      rule: type[SlidingWindow] = SlidingWindow) -> DataFrame:
    """The sliding-window limiter on a stream; a key's state goes once the watermark passes its window.

    Events behind the watermark (``lateness`` behind the newest event seen) are dropped.
    """
    window = window_seconds * 1_000_000
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("event_us", micros(F.col(ts))).withWatermark(ts, lateness)
    return stream_fold(timed, keys, ["event_us", order], rule(limit, window), expire_us=window).drop("event_us")


def stream_block_notices(decisions: DataFrame, keys: list[str], ts: str, order: str, *,
                         window_seconds: int = fv.RATE_WINDOW_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """At most one notice per window over a stream of limiter decisions (``allowed = false`` rows)."""
    blocked = decisions.where(~F.col("allowed")).drop("allowed", "retry_after")
    limited = stream_rate_limit(blocked, keys, ts, order, limit=1, window_seconds=window_seconds, lateness=lateness)
    return limited.withColumnRenamed("allowed", "notify").drop("retry_after")


class ReportProcessor(StatefulProcessor):
    """Duplicate and spacing checks per reporter; accepted answers sit in map state, read one by one, the last reports of a bucket together."""

    def __init__(self, spacing_us: int, reporter: T.StructField, columns: list[str]):
        self.spacing_us, self.reporter, self.columns = spacing_us, reporter, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = T.StructType([T.StructField("v", T.LongType())])
        self.last = handle.getListState("last", T.StructType([self.reporter, T.StructField("v", T.LongType())]))
        self.seen = handle.getMapState("seen", T.StructType([self.reporter, T.StructField("m", T.LongType())]), number)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["event_us", "id"], kind="stable")
        fold = ReportSpacing(self.spacing_us)
        reporters, named = _of_key(frame[self.reporter.name], self.reporter.dataType), frame["message_id"].tolist()
        last = {row[0]: row[1] for row in self.last.get()}
        known = {(r, m) for r, m in dict.fromkeys(zip(reporters, named)) if self.seen.containsKey((r, int(m)))}
        states, results = {}, []
        for r in reporters:
            states.setdefault(r, {"last": last.get(r), "seen": set()})
        for r, m in known:
            states[r]["seen"].add(m)
        for r, t, m in zip(reporters, frame["event_us"].tolist(), named):
            results.append(fold.step(states[r], t, m))
        for r, state in states.items():
            for m in state["seen"]:
                if (r, m) not in known:
                    self.seen.updateValue((r, int(m)), (1,))
            if state["last"] is not None:
                last[r] = state["last"]
        self.last.put([(r, int(t)) for r, t in last.items()])
        frame["verdict"] = [r[0] for r in results]
        frame["retry_after"] = pd.Series([r[1] for r in results], index=frame.index, dtype="float64")
        yield frame[self.columns]

    def close(self) -> None:
        pass


def stream_report_guard(reports: DataFrame, messages: DataFrame, *, spacing_seconds: int = fv.REPORT_SPACING_SECONDS,
                        buckets: int = BUCKETS) -> DataFrame:
    """Verdicts (``verdict, retry_after``) for a stream of reports of answers held in the static ``messages``.

    Reports of missing messages or of user messages are judged by the static join and pass by the keyed state.
    """
    use_rocksdb(reports.sparkSession)
    roles = messages.select(F.col("id").alias("message_id"), F.col("role").alias("_role"))
    target = reports.join(roles, "message_id", "left").select(*reports.columns, "_role").withColumn("event_us", micros(F.col("created_at")))
    answers = target.where(F.col("_role") == "assistant").drop("_role")
    schema = T.StructType(answers.schema.fields + [T.StructField("verdict", T.StringType()), T.StructField("retry_after", T.DoubleType())])
    reporter = T.StructField("reported_by_user_id", answers.schema["reported_by_user_id"].dataType)
    judged = _bucketed(answers, [reporter.name], buckets).groupBy(BUCKET).transformWithStateInPandas(
        ReportProcessor(spacing_seconds * 1_000_000, reporter, schema.fieldNames()), schema, "Append", "None")
    rejected = target.where(F.col("_role").isNull() | (F.col("_role") != "assistant")).select(
        *[c for c in answers.columns], F.when(F.col("_role").isNull(), "message_not_found").otherwise("not_an_answer").alias("verdict"),
        F.lit(None).cast("double").alias("retry_after"))
    return judged.unionByName(rejected).drop("event_us")


class ReportDialogue(Fold):
    """The two-step report dialogue of a session: latest answer and pending target, -1 for none."""

    inputs = ["id", "role", "report_flag"]
    outputs = [("action", T.StringType()), ("target_message_id", T.LongType())]
    state_type = T.ArrayType(T.LongType())

    def start(self, carried):
        return {"answer": carried[0], "pending": carried[1]} if carried else {"answer": -1, "pending": -1}

    def step(self, state, number, role, is_report):
        if role == "assistant":
            state["answer"] = number
        if role != "user":
            return None, None
        if is_report:
            if state["answer"] < 0:
                return "no_answer", None
            state["pending"] = state["answer"]
            return "prompt_reason", None
        target, state["pending"] = state["pending"], -1
        return ("file_reason", target) if target >= 0 else ("question", None)

    def carry(self, state):
        return [state["answer"], state["pending"]]


def stream_report_labels(messages: DataFrame, is_report=None) -> DataFrame:
    """``report_labels`` for a stream of messages."""
    keyword = is_report if is_report is not None else is_report_keyword(F.col("text"))
    marked = messages.withColumn("report_flag", keyword)
    labelled = stream_fold(marked, ["session_id"], ["id"], ReportDialogue())
    return labelled.where(F.col("role") == "user").drop("report_flag")
