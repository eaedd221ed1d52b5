"""Abuse guards over message and report tables: sliding-window limits, report checks, reporter counts."""

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baraza import fixed_values as fv
from baraza.operators.chain import paced
from baraza.operators.grouped import with_group_counts
from baraza.operators.ordered import running_sum
from baraza.operators.sequential import MAX_ROWS, Fold, largest_key, one_pass, sequential_scan


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


class SlidingWindow(Fold):
    """At most ``limit`` allowed events per window; a blocked attempt leaves no trace."""

    outputs = [("allowed", T.BooleanType()), ("retry_after", T.DoubleType())]
    state_type = T.ArrayType(T.LongType())

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window = limit, window_us
        self.inputs = ["event_us"]

    def start(self, carried):
        return deque(carried or ())

    def step(self, state, t):
        while state and state[0] <= t - self.window:
            state.popleft()
        if len(state) < self.limit:
            state.append(t)
            return True, 0.0
        return False, max(0.0, (state[0] + self.window - t) / 1e6)

    def carry(self, state):
        return list(state)


class MessageWindow(SlidingWindow):
    """The limiter over a whole conversation log: only user messages count, answers pass."""

    def __init__(self, limit: int, window_us: int):
        super().__init__(limit, window_us)
        self.inputs = ["event_us", "role"]

    def step(self, state, t, role):
        return super().step(state, t) if role == "user" else (True, 0.0)


def crowded(timed: DataFrame, keys: list[str], order: str, limit: int, window: int) -> DataFrame:
    """Add ``crowded``: may the limiter block a row of this island?

    A pause of a window ends an island and empties the limiter. In an island where every row lies at least a window behind its
    ``limit``-th predecessor nothing is blocked, so nothing in it depends on earlier decisions.
    """
    by_key = Window.partitionBy(*keys).orderBy("event_us", order)
    pause = F.col("event_us") - F.lag("event_us").over(by_key)
    close = F.col("event_us") - F.lag("event_us", limit).over(by_key) < window
    marked = timed.withColumns({"_opens": F.coalesce(pause >= window, F.lit(True)).cast("int"), "_close": F.coalesce(close, F.lit(False))})
    marked = marked.withColumn("_island", F.sum("_opens").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("crowded", F.max("_close").over(Window.partitionBy(*keys, "_island"))).drop("_opens", "_close", "_island")


def rate_limit(events: DataFrame, keys: list[str], ts: str, order: str, *, limit: int = fv.RATE_LIMIT,
               window_seconds: int = fv.RATE_WINDOW_SECONDS, rule: type[SlidingWindow] = SlidingWindow,
               max_rows: int = MAX_ROWS) -> DataFrame:
    """Add ``allowed`` and ``retry_after`` (seconds) per event, in ``(ts, order)`` order within the key.

    Where one key may outgrow a task (``max_rows``) a limit of one per window is decided by pointers instead of a scan
    (``operators.chain``), and other limits in bounded segments. Below that the rows of islands that cannot be blocked are decided by
    built-in windows, and only crowded islands reach the fold.
    """
    window = window_seconds * 1_000_000
    timed = events.withColumn("event_us", micros(F.col(ts)))
    largest = largest_key(timed, keys)
    if largest > max_rows and limit == 1 and rule is SlidingWindow:
        decided = paced(timed, keys, "event_us", [order], window)
        wait = F.when(F.col("in_chain"), 0.0).otherwise((F.col("last_time") + window - F.col("event_us")) / 1e6)
        return decided.select(*events.columns, F.col("in_chain").alias("allowed"), wait.alias("retry_after"))
    fold = rule(limit, window)
    if largest > max_rows or rule is not SlidingWindow:
        return sequential_scan(timed, keys, "event_us", ["event_us", order], fold, quiet_us=window, max_rows=max_rows,
                               largest=largest).drop("event_us")
    marked = crowded(timed, keys, order, limit, window)
    free = marked.where(~F.col("crowded")).withColumns({"allowed": F.lit(True), "retry_after": F.lit(0.0)})
    scanned = one_pass(marked.where("crowded"), fold, keys, ["event_us", order])
    return free.unionByName(scanned).drop("event_us", "crowded")


def folded_share(events: DataFrame, keys: list[str], ts: str, order: str, *, limit: int = fv.RATE_LIMIT,
                 window_seconds: int = fv.RATE_WINDOW_SECONDS) -> DataFrame:
    """``(events, folded)``: how many rows there are, and how many of them only the fold can decide."""
    window = window_seconds * 1_000_000
    marked = crowded(events.withColumn("event_us", micros(F.col(ts))), keys, order, limit, window)
    return marked.agg(F.count("*").alias("events"), F.count_if("crowded").alias("folded"))


def block_notices(decisions: DataFrame, keys: list[str], ts: str, order: str, *,
                  window_seconds: int = fv.RATE_WINDOW_SECONDS, max_rows: int = MAX_ROWS) -> DataFrame:
    """The blocked events with ``notify``: at most one notice per window, fed by blocked events only."""
    blocked = decisions.where(~F.col("allowed")).withColumnRenamed("retry_after", "wait_seconds").drop("allowed")
    limited = rate_limit(blocked, keys, ts, order, limit=1, window_seconds=window_seconds, max_rows=max_rows)
    return limited.withColumnRenamed("allowed", "notify").drop("retry_after")


class ReportSpacing(Fold):
    """Per reporter: one accepted report per answer, and a pause after each accepted report.

    Accepted reports are at least one pause apart, so the remembered answers are bounded by time span / pause.
    """

    inputs = ["event_us", "message_id"]
    outputs = [("verdict", T.StringType()), ("retry_after", T.DoubleType())]
    state_type = T.ArrayType(T.LongType())

    def __init__(self, spacing_us: int):
        self.spacing = spacing_us

    def start(self, carried):
        return {"last": carried[0], "seen": set(carried[1:])} if carried else {"last": None, "seen": set()}

    def step(self, state, t, message_id):
        if message_id in state["seen"]:
            return "duplicate", None
        if state["last"] is not None and t - state["last"] < self.spacing:
            return "rate_limited", round((self.spacing - (t - state["last"])) / 1e6, 1)
        state["last"] = t
        state["seen"].add(message_id)
        return "created", None

    def carry(self, state):
        return [] if state["last"] is None else [state["last"], *state["seen"]]


def _spaced(answers: DataFrame, spacing_us: int, max_rows: int) -> DataFrame:
    """``verdict`` and ``retry_after`` of reports on answers.

    A reporter who may outgrow a task and never names an answer twice can have no duplicates; then only the pause counts, and
    the accepted reports are a chain of pointers. Every other reporter is scanned.
    """
    key, fold = "reported_by_user_id", ReportSpacing(spacing_us)
    largest = largest_key(answers, [key])
    if largest <= max_rows:
        return sequential_scan(answers, [key], "event_us", ["event_us", "id"], fold, max_rows=max_rows, largest=largest)
    flooding = answers.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("message_id").alias("named"))
    flooding = flooding.where((F.col("n") > max_rows) & (F.col("n") == F.col("named"))).select(key)
    paced_rows = paced(answers.join(flooding, key, "left_semi"), [key], "event_us", ["id"], spacing_us)
    wait = F.round((F.lit(spacing_us) - (F.col("event_us") - F.col("last_time"))) / 1e6, 1)
    chained = paced_rows.select(*answers.columns, F.when(F.col("in_chain"), "created").otherwise("rate_limited").alias("verdict"),
                                F.when(~F.col("in_chain"), wait).alias("retry_after"))
    scanned = sequential_scan(answers.join(flooding, key, "left_anti"), [key], "event_us", ["event_us", "id"], fold, max_rows=max_rows)
    return chained.unionByName(scanned)


def report_guard(reports: DataFrame, messages: DataFrame, *, spacing_seconds: int = fv.REPORT_SPACING_SECONDS,
                 flag_threshold: int = fv.FLAG_THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """Verdict per report: ``created, reason, report_count, flagged_for_review, retry_after``.

    ``reports`` has ``id`` (arrival number), ``message_id``, ``reported_by_user_id``, ``created_at``;
    checks run in the order target exists, target is an answer, duplicate, spacing.
    """
    roles = messages.select(F.col("id").alias("message_id"), F.col("role").alias("_role"))
    target = reports.join(roles, "message_id", "left").select(*reports.columns, "_role")
    target = target.withColumn("event_us", micros(F.col("created_at")))
    answers = target.where(F.col("_role") == "assistant")
    judged = _spaced(answers, spacing_seconds * 1_000_000, max_rows)
    rejected = target.where(F.col("_role").isNull() | (F.col("_role") != "assistant")).withColumns({
        "verdict": F.when(F.col("_role").isNull(), "message_not_found").otherwise("not_an_answer"),
        "retry_after": F.lit(None).cast("double")})
    # Accepted reports are unique per (answer, reporter), so their running count is the distinct-reporter count.
    counted = running_sum(judged, ["message_id"], "id", (F.col("verdict") == "created").cast("long"), "_count")
    rows = counted.unionByName(rejected.withColumn("_count", F.lit(0).cast("long")))
    seen = F.when(F.col("verdict").isin("created", "duplicate"), F.col("_count")).otherwise(0)
    return rows.select(
        *reports.columns, (F.col("verdict") == "created").alias("created"), F.col("verdict").alias("reason"),
        seen.cast("long").alias("report_count"), (seen >= flag_threshold).alias("flagged_for_review"), "retry_after")


def guard_reply(created: Column, flagged: Column, reason: Column, retry_after: Column) -> Column:
    """The two-language reply for a guard verdict."""

    def both(name, *args):
        parts = [F.format_string(t, *args) if args else F.lit(t) for t in fv.REPORT_REPLY_TEXT[name]]
        text = F.concat_ws("\n", *parts)
        return text if args else F.concat(text, F.lit(fv.REPLY_SUFFIX))

    wait = F.coalesce(retry_after, F.lit(0.0)).cast("int")
    return (F.when(created & flagged, both("flagged")).when(created, both("created"))
            .when(reason == "duplicate", both("duplicate"))
            .when(reason == "rate_limited", both("rate_limited", wait)).otherwise(both("no_recent")))


def already_reported(reports: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``asked`` (``message_id, reported_by_user_id``) that have a report."""
    known = reports.select("message_id", "reported_by_user_id").distinct()
    return asked.join(known, ["message_id", "reported_by_user_id"], "left_semi")


def distinct_reporters(reports: DataFrame) -> DataFrame:
    """Distinct reporters per answer."""
    return reports.groupBy("message_id").agg(F.countDistinct("reported_by_user_id").alias("reporters"))


#: Registers of a sketch as a power of two: a standard error of 1.04 / sqrt(4096) = 1.6 %, so three of them stay below 5 %.
SKETCH_BITS = 12


def reporter_sketches(reports: DataFrame) -> DataFrame:
    """``(message_id, day, sketch)``: one small mergeable sketch of the reporters of an answer and day, to be stored once."""
    return reports.groupBy("message_id", F.to_date("created_at").alias("day")).agg(
        F.hll_sketch_agg("reported_by_user_id", SKETCH_BITS).alias("sketch"))


def reporters_from_sketches(sketches: DataFrame) -> DataFrame:
    """Approximate distinct reporters per answer over the days of ``sketches``; no report is read again.

    Answers with up to some hundred reporters are counted exactly, larger ones within 5 % (three standard errors).
    """
    merged = sketches.groupBy("message_id").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("message_id", F.hll_sketch_estimate("sketch").alias("reporters"))


def backfill_counts(disputes: DataFrame, flag_threshold: int = fv.FLAG_THRESHOLD) -> DataFrame:
    """Write rows-per-answer and the review flag on every report row."""
    base = disputes.drop("report_count", "flagged_for_review")
    counted = with_group_counts(base, ["message_id"], {"report_count": F.count("*")})
    return counted.withColumn("flagged_for_review", F.col("report_count") >= flag_threshold)
