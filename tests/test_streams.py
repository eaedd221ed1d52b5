"""Streams over several micro-batches give what the batch jobs give."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baraza.operators import guards
from baraza.plans import conversations, replay
from baraza.streaming import ingest, keyed, running, stateful, versioned, windows
from baraza.streaming.replay import stream_replay

EVENT = T.StructType([T.StructField("user", T.LongType()), T.StructField("id", T.LongType()), T.StructField("t", T.LongType())])
MESSAGE = T.StructType([T.StructField("id", T.LongType()), T.StructField("session_id", T.LongType()), T.StructField("user_id", T.LongType()),
                        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("t", T.LongType())])


def write_parts(folder, frame, parts):
    """Consecutive slices as files in arrival order."""
    os.makedirs(folder, exist_ok=True)
    size = -(-len(frame) // parts)
    for n in range(parts):
        path = f"{folder}/part{n}.parquet"
        frame.iloc[n * size:(n + 1) * size].to_parquet(path, index=False)
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    return str(folder)


START = 1_700_000_000  # a watermark starts at the epoch, so event times lie well after it


def timed(df):
    return df.withColumn("ts", F.timestamp_seconds(F.col("t") + START))


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rnd = random.Random(2)
    times = sorted(rnd.randint(0, 3000) for _ in range(120))
    frame = pd.DataFrame({"user": [rnd.randint(1, 3) for _ in times], "id": range(len(times)), "t": times})
    folder = write_parts(tmp_path_factory.mktemp("events") / "in", frame, 3)
    return timed(spark.read.schema(EVENT).parquet(folder)).drop("t"), lambda: timed(running.read_stream(spark, folder, EVENT, 1)).drop("t")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_limiter_and_notices(events):
    table, stream = events
    batch = guards.rate_limit(table, ["user"], "ts", "id", limit=2, window_seconds=120)
    limited = running.run_to_table(stateful.stream_rate_limit(stream(), ["user"], "ts", "id", limit=2, window_seconds=120), "limit")
    assert rows(limited, "id", "allowed", "retry_after") == rows(batch, "id", "allowed", "retry_after")
    folder = limited.inputFiles()[0].rsplit("/", 1)[0]
    again = running.read_stream(limited.sparkSession, folder, limited.schema)
    notified = running.run_to_table(stateful.stream_block_notices(again, ["user"], "ts", "id", window_seconds=120), "notice")
    want = guards.block_notices(batch, ["user"], "ts", "id", window_seconds=120)
    assert rows(notified, "id", "notify") == rows(want, "id", "notify")


def test_expired_state_is_dropped(spark, tmp_path):
    """A key silent for longer than its window starts afresh - with timers clearing it on the way."""
    frame = pd.DataFrame({"user": [1, 2, 2, 1, 1], "id": range(5), "t": [0, 4000, 9000, 9001, 9002]})
    folder = write_parts(tmp_path / "in", frame, 5)
    stream = timed(running.read_stream(spark, folder, EVENT, 1)).drop("t")
    got = running.run_to_table(stateful.stream_rate_limit(stream, ["user"], "ts", "id", limit=1, window_seconds=60, lateness="10 seconds"), "expire")
    assert rows(got, "id", "allowed") == [(0, True), (1, True), (2, True), (3, True), (4, False)]


def test_report_guard(spark, events):
    table, stream = events
    answers = spark.createDataFrame([(1, "assistant"), (2, "user"), (3, "assistant")], "id long, role string")

    def reports(df):
        return df.select("id", (F.col("id") % 4 + 1).alias("message_id"), F.col("user").alias("reported_by_user_id"), F.col("ts").alias("created_at"))

    batch = guards.report_guard(reports(table), answers, spacing_seconds=100)
    got = running.run_to_table(stateful.stream_report_guard(reports(stream()), answers, spacing_seconds=100), "guard")
    assert rows(got, "id", "verdict", "retry_after") == rows(batch, "id", "reason", "retry_after")


def test_windows_and_counts(spark, events):
    table, stream = events
    asked = lambda df: df.select(F.lit("user").alias("role"), (F.col("ts") + F.expr("make_dt_interval(int(id))")).alias("created_at"), "user")
    weekly = versioned.run_versioned(windows.stream_query_volume(asked(stream()), "week", lateness="400 days"), ["start"], "weekly")
    assert rows(weekly, "start", "queries") == rows(asked(table).groupBy(F.date_trunc("week", "created_at").alias("start")).agg(
        F.count("*").alias("queries")), "start", "queries")
    made = windows.stream_sessions(stream().withColumnRenamed("ts", "created_at"), "user", "60 seconds", lateness="10 minutes")
    sessions = windows.sessions_so_far(made, "user", "sessions")
    whole = table.groupBy("user", F.session_window("ts", "60 seconds").alias("w")).agg(F.count("*").alias("messages")).select("user", "w.start", "w.end", "messages")
    assert rows(sessions, "user", "start", "end", "messages") == rows(whole, "user", "start", "end", "messages")
    assert {r.is_open: r["count"] > 0 for r in sessions.groupBy("is_open").count().collect()} == {True: True, False: True}
    reports = lambda df: df.select((F.col("id") % 5).alias("message_id"), F.col("user").alias("reported_by_user_id"), F.col("ts").alias("created_at"))
    counts = running.run_latest(windows.stream_reporter_counts(reports(stream()), 3, approximate=True), "approx")
    assert all(r["reporters"] == 3 and r["flagged"] for r in counts.collect())


REPORT = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "message_id", "reported_by_user_id", "t")])


def test_running_decisions_take_reports_in_any_order(spark, tmp_path):
    """First reports and reporter counts after every batch, read from whole versions only; a batch that comes again changes nothing."""
    rnd = random.Random(4)
    made = [(i, rnd.randint(1, 6), rnd.choice([1, 2, 3, 4, None]), rnd.randint(0, 500)) for i in range(200)]
    frame = pd.DataFrame(made, columns=["id", "message_id", "reported_by_user_id", "t"]).astype("Int64")
    folder = write_parts(tmp_path / "in", frame, 5)

    def stream():
        return running.read_stream(spark, folder, REPORT, 1).withColumn("created_at", F.timestamp_seconds(F.col("t") + START)).drop("t")

    first = versioned.run_versioned(windows.stream_first_reports(stream()), ["message_id", "reported_by_user_id"], "first")
    want = {}
    for i, m, r, t in made:
        want[m, r] = min(want.get((m, r), (t, i)), (t, i))
    assert {(x.message_id, x.reported_by_user_id): x.id for x in first.collect()} == {k: v[1] for k, v in want.items()}
    counts = versioned.run_versioned(windows.stream_distinct_reporters(stream(), 4), ["message_id"], "counts")
    assert {x.message_id: (x.reporters, x.flagged) for x in counts.collect()} == {
        m: (len({r for n, r in want if n == m and r}), len({r for n, r in want if n == m and r}) >= 4) for m in {m for m, _ in want}}


def test_versions(spark, tmp_path):
    """Readers see entered versions only; compaction and repeated batches change nothing; removed keys are gone."""
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    table = versioned.Versioned(spark, str(tmp_path / "t"), schema, ["k"], compact_every=3)

    def change(*made):
        return spark.createDataFrame([(k, v, v is None) for k, v in made], "k long, v string, _gone boolean")

    now = lambda: {r.k: r.v for r in table.read().collect()}
    assert now() == {}
    table.commit(0, change((1, "a"), (2, "b"), (None, "n")))
    spark.createDataFrame([(9, "x", False, 5)], table.stored).write.parquet(f"{table.folder}/changes-5")  # written, not entered
    assert now() == {1: "a", 2: "b", None: "n"}
    table.commit(1, change((2, None), (3, "c")))
    table.commit(1, change((1, "again")))
    assert now() == {1: "a", 3: "c", None: "n"}
    table.commit(2, change((3, "d"), (None, "m")))
    assert "base-2" in table.manifest.entries() and now() == {1: "a", 3: "d", None: "m"}
    table.commit(2, change((1, "again")))
    table.commit(3, change((2, "e")))
    assert now() == {1: "a", 2: "e", 3: "d", None: "m"}


def test_a_batch_reads_what_it_brings(spark, tmp_path):
    """Rows read by the ingestion do not grow with what has arrived before."""
    frame = pd.DataFrame({"source": ["a"] * 60, "page": range(60), "text": [f"some words of page {i} " * 5 for i in range(60)]})
    folder = write_parts(tmp_path / "in", frame, 6)
    chunks, outcomes = ingest.ingest_arrivals(running.read_stream(spark, folder, PAGES, 1), known_sources(spark), "nakuru", str(tmp_path / "t"), str(tmp_path / "c2"), size=10, overlap=0)
    assert sorted(r.chunk_index for r in chunks.collect()) == list(range(60 * 3)) and [r.page_count for r in outcomes.collect()] == [60]
    # every version holds the pages of its own batch only
    assert [spark.read.parquet(f"{tmp_path}/t/changes-{i}").count() for i in range(6)] == [10] * 6


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rnd = random.Random(8)
    texts = ["report", "si kweli", "because it is wrong", "how much"]
    frame = pd.DataFrame([{"id": i, "session_id": s, "user_id": s % 3, "role": rnd.choice(["user", "user", "assistant"]), "text": rnd.choice(texts), "t": i * 7}
                          for i in range(150) for s in [rnd.randint(0, 5)]])
    folder = write_parts(tmp_path_factory.mktemp("log") / "in", frame, 3)
    made = lambda df: df.withColumn("created_at", F.timestamp_seconds(F.col("t") + START)).drop("t")
    return made(spark.read.schema(MESSAGE).parquet(folder)), lambda: made(running.read_stream(spark, folder, MESSAGE, 1))


def test_dialogue(log):
    table, stream = log
    batch = conversations.report_labels(table)
    got = running.run_to_table(stateful.stream_report_labels(stream()), "dialogue")
    assert rows(got, "id", "action", "target_message_id") == rows(batch, "id", "action", "target_message_id")
    assert batch.where("action = 'file_reason'").count() > 3


def test_replay(log):
    table, stream = log
    limits = dict(limit=4, window_seconds=60, spacing_seconds=20, flag_threshold=2)
    labelled, verdicts = replay.replay(table, **limits)
    got_labels, got_verdicts, counts = stream_replay(stream(), table, **limits)
    assert rows(got_labels, "id", "action") == rows(labelled, "id", "action")
    assert rows(got_verdicts, "id", "verdict") == rows(verdicts, "id", "reason")
    want = verdicts.where("created").groupBy("message_id").agg(F.count("*").alias("reporters"))
    assert rows(counts, "message_id", "reporters") == rows(want, "message_id", "reporters")


PAGES = T.StructType([T.StructField("source", T.StringType()), T.StructField("page", T.LongType()), T.StructField("text", T.StringType())])


def known_sources(spark):
    return spark.createDataFrame([(1, "a", "executive", "nakuru"), (2, "b", "assembly", "nakuru"), (3, "c", "assembly", "nakuru")],
                                 "id long, title string, government_arm string, county string")


def test_ingest_takes_pages_in_any_batch(spark, tmp_path):
    """Pages of one source over several micro-batches; a page that comes again replaces its text; a source that ends unreadable ends empty."""
    frame = pd.DataFrame({"source": ["a", "b", "c", "a", "a", "c"], "page": [1, 1, 1, 2, 1, 1],
                          "text": ["old words " * 20, "other words " * 20, "c words " * 10, "second page " * 15, "new " * 12, "short"]})
    folder = write_parts(tmp_path / "in", frame, 6)
    got, outcomes = ingest.ingest_arrivals(running.read_stream(spark, folder, PAGES, 1), known_sources(spark), "nakuru", str(tmp_path / "table"), str(tmp_path / "cp"),
                                           size=10, overlap=0)
    assert {r.source_id: r.status for r in outcomes.collect()} == {1: "completed", 2: "completed", 3: "failed"}
    assert {r["source_id"]: r["count"] for r in got.groupBy("source_id").count().collect()} == {1: 2 + 3, 2: 4}
    assert sorted(r.chunk_index for r in got.where("source_id = 1").collect()) == list(range(5))


def test_decisions_by_key_need_no_order(events, spark, tmp_path):
    table, _ = events
    plain = table.select("user", "id", (F.unix_timestamp("ts") - START).alias("t")).toPandas()
    folder = write_parts(tmp_path / "in", plain.sample(frac=1, random_state=3), 4)
    stream = timed(running.read_stream(spark, folder, EVENT, 1)).drop("t")
    batch = guards.rate_limit(table, ["user"], "ts", "id", limit=2, window_seconds=120)
    got = keyed.decided(stream, ["user"], lambda rows: guards.rate_limit(rows, ["user"], "ts", "id", limit=2, window_seconds=120), "any-order", buckets=4)
    assert rows(got, "id", "allowed", "retry_after") == rows(batch, "id", "allowed", "retry_after")


def test_a_run_that_would_lose_rows_fails(spark, tmp_path):
    frame = pd.DataFrame({"user": [1, 1, 1], "id": [1, 2, 3], "t": [90_000, 100_000, 10]})
    folder = write_parts(tmp_path / "in", frame, 3)
    stream = timed(running.read_stream(spark, folder, EVENT, 1)).drop("t")
    with pytest.raises(RuntimeError, match="behind the watermark"):
        running.run_to_table(stateful.stream_rate_limit(stream, ["user"], "ts", "id", limit=2, window_seconds=120), "late")


def test_keys_share_the_state_of_their_bucket(spark, tmp_path):
    """Many keys, a null one too, over several batches: decisions are those of the batch guards, the state has a key for each bucket only."""
    rnd = random.Random(9)
    times = sorted(rnd.randint(0, 3000) for _ in range(600))
    frame = pd.DataFrame({"user": [rnd.choice([None, *range(60)]) for _ in times], "id": range(len(times)), "t": times}).astype("Int64")
    folder = write_parts(tmp_path / "in", frame, 3)
    table, stream = timed(spark.read.schema(EVENT).parquet(folder)).drop("t"), lambda: timed(running.read_stream(spark, folder, EVENT, 1)).drop("t")
    schema = ["user", "id", "allowed", "retry_after"]

    limited = stateful.stream_fold(stream().withColumn("event_us", guards.micros(F.col("ts"))), ["user"], ["event_us", "id"],
                                   guards.SlidingWindow(1, 200_000_000), buckets=4)
    made = running.run_to_folder(limited, "buckets")
    assert rows(spark.read.schema(limited.schema).parquet(f"{made}/table"), *schema) == rows(
        guards.rate_limit(table, ["user"], "ts", "id", limit=1, window_seconds=200), *schema)
    kept = running.read_state(spark, f"{made}/checkpoint", "kept")
    assert kept.select("key").distinct().count() <= 4 and kept.select("list_element.user").distinct().count() == 61

    reports = lambda df: df.select("id", (F.col("id") % 7).alias("message_id"), F.col("user").alias("reported_by_user_id"), F.col("ts").alias("created_at"))
    answers = spark.range(6).select("id", F.lit("assistant").alias("role"))
    judged = running.run_to_table(stateful.stream_report_guard(reports(stream()), answers, spacing_seconds=100, buckets=4), "judged")
    assert rows(judged, "id", "verdict", "retry_after") == rows(
        guards.report_guard(reports(table), answers, spacing_seconds=100), "id", "reason", "retry_after")
