"""Replaying a message log through all guards, as one batch job."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baraza import fixed_values as fv
from baraza.operators.guards import MessageWindow, rate_limit, report_guard
from baraza.plans.conversations import report_labels


def filed_reports(labelled: DataFrame) -> DataFrame:
    """Reports filed by labelled messages; the filing message's id is the arrival number."""
    return labelled.where(F.col("action") == "file_reason").select(
        "id", F.col("target_message_id").alias("message_id"), F.col("user_id").alias("reported_by_user_id"),
        F.col("text").alias("reason_text"), "created_at")


def replay(messages: DataFrame, *, limit: int = fv.RATE_LIMIT, window_seconds: int = fv.RATE_WINDOW_SECONDS,
           spacing_seconds: int = fv.REPORT_SPACING_SECONDS, flag_threshold: int = fv.FLAG_THRESHOLD,
           is_report: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(labelled messages, report verdicts)`` of a log with ``id, session_id, user_id, role, text, created_at``.

    User messages pass the limiter per user; the allowed ones and all answers run through the report
    dialogue; filed reports pass the report guard.
    """
    limited = rate_limit(messages, ["user_id"], "created_at", "id", limit=limit, window_seconds=window_seconds,
                         rule=MessageWindow)
    kept = limited.where("allowed").drop("allowed", "retry_after")
    labelled = report_labels(kept, is_report)
    verdicts = report_guard(filed_reports(labelled), messages.select("id", "role"), spacing_seconds=spacing_seconds,
                            flag_threshold=flag_threshold)
    return labelled, verdicts
