"""Windowed and de-duplicating streams on built-in operators: state per key, changed keys only in what a batch emits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baraza import fixed_values as fv
from baraza.streaming.running import read_state, run_to_folder, use_rocksdb


def _event_time(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def stream_query_volume(messages: DataFrame, unit: str = "day", ts: str = "created_at", lateness: str = "1 day") -> DataFrame:
    """User questions per day or Monday-based week; the state of a window goes once the watermark has passed it."""
    # The epoch's fifth day is a Monday, hence the offset of the weekly window.
    window = F.window(ts, "1 day") if unit == "day" else F.window(ts, "7 days", "7 days", "4 days")
    asked = _event_time(messages, ts, lateness).where(F.col("role") == "user")
    return asked.groupBy(window.alias("w")).agg(F.count("*").alias("queries")).select(F.col("w.start").alias("start"), "queries")


def stream_sessions(messages: DataFrame, key: str, gap: str, ts: str = "created_at", lateness: str = "1 hour") -> DataFrame:
    """Sessions by inactivity: a pause of ``gap`` ends one."""
    return _event_time(messages, ts, lateness).groupBy(key, F.session_window(ts, gap).alias("w")).agg(
        F.count("*").alias("messages")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "messages")


def sessions_so_far(sessions: DataFrame, key: str, label: str) -> DataFrame:
    """Run ``stream_sessions`` over everything available now: the sessions that have ended, each written once when the watermark passes
    it, and those still open, read back from the state (``is_open``). Nothing is written again, and the state holds open sessions only.
    """
    spark = sessions.sparkSession
    folder = run_to_folder(sessions, label)
    ended = spark.read.schema(sessions.schema).parquet(f"{folder}/table").withColumn("is_open", F.lit(False))
    state = F.col("value")
    open_ = read_state(spark, f"{folder}/checkpoint").select(
        state[key].alias(key), state["session_window"]["start"].alias("start"), state["session_window"]["end"].alias("end"),
        state["count"].alias("messages"), F.lit(True).alias("is_open"))
    return ended.unionByName(open_)


def stream_first_reports(reports: DataFrame) -> DataFrame:
    """The earliest report for each (answer, reporter), for ever and in any order of arrival: for update mode.

    One small state per pair; a batch emits the pairs that are new or got an earlier report.
    """
    use_rocksdb(reports.sparkSession)
    row = F.struct(*reports.columns)
    first = reports.groupBy(F.col("message_id").alias("_m"), F.col("reported_by_user_id").alias("_r")).agg(
        F.min_by(row, F.struct("created_at", "id")).alias("row"))
    return first.select("row.*")


def stream_distinct_reporters(reports: DataFrame, flag_threshold: int = fv.FLAG_THRESHOLD) -> DataFrame:
    """Distinct reporters for each answer, and whether they reach the review threshold: for update mode.

    Pairs seen before go out in the first state, counts grow in the second; a batch emits the answers that gained a reporter.
    """
    use_rocksdb(reports.sparkSession)
    pairs = reports.select("message_id", "reported_by_user_id").dropDuplicates(["message_id", "reported_by_user_id"])
    counted = pairs.groupBy("message_id").agg(F.count("reported_by_user_id").alias("reporters"))
    return counted.withColumn("flagged", F.col("reporters") >= flag_threshold)


def stream_reporter_counts(accepted: DataFrame, flag_threshold: int = fv.FLAG_THRESHOLD, approximate: bool = False) -> DataFrame:
    """Reporters per answer and whether they reach the review threshold.

    Accepted reports are unique per (answer, reporter), so a count is exact; for raw reports use the sketch.
    """
    count = F.approx_count_distinct("reported_by_user_id") if approximate else F.count("*")
    return accepted.groupBy("message_id").agg(count.alias("reporters")).withColumn(
        "flagged", F.col("reporters") >= flag_threshold)
