"""Serialised forms of table rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iso(ts: Column) -> Column:
    """ISO-8601 text of a UTC time; null stays null."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def source_rows(sources: DataFrame, chunk_counts: DataFrame | None = None) -> DataFrame:
    """Sources in their listing form, newest first, with chunk counts (missing = 0)."""
    rows = sources
    if chunk_counts is not None:
        rows = rows.join(chunk_counts.select(F.col("source_id").alias("id"), "chunk_count"), "id", "left")
    else:
        rows = rows.withColumn("chunk_count", F.lit(0).cast("long"))
    # sorted behind the join, which would lose an earlier order
    return rows.orderBy(F.desc("created_at"), F.asc("id")).select(
        "id", "url", "title", "publisher", "government_arm", "county", "report_type", "fiscal_year",
        iso(F.col("published_at")).alias("published_at"), iso(F.col("last_scraped_at")).alias("last_scraped_at"),
        "ingestion_status", "ingestion_error", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        iso(F.col("created_at")).alias("created_at"))


def dispute_rows(disputes: DataFrame) -> DataFrame:
    return disputes.select(
        "id", "message_id", "status", "reason", "reported_by_user_id", "report_count", "flagged_for_review",
        "reviewed_by", iso(F.col("reviewed_at")).alias("reviewed_at"), "resolution_note", "escalation_report",
        iso(F.col("created_at")).alias("created_at"))
