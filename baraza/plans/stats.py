"""The overview report and query volumes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baraza import fixed_values as fv
from baraza.operators.grouped import counts_by_value
from baraza.plans.moderation import dispute_status_counts
from baraza.plans.quality import one_row


def day_start(now: Column) -> Column:
    return F.date_trunc("day", now)


def week_start(now: Column) -> Column:
    """Monday, midnight."""
    return F.date_trunc("week", now)


def overview(sources: DataFrame, chunks: DataFrame, messages: DataFrame, users: DataFrame, disputes: DataFrame,
             now: Column) -> DataFrame:
    """Corpus health and usage in one row: one pass per table."""
    source_stats = sources.agg(
        F.count("*").alias("total_sources"), *counts_by_value(F.col("ingestion_status"), fv.INGESTION_STATUSES, "sources_"),
        F.max(F.when(F.col("ingestion_status") == "completed", F.col("last_scraped_at"))).alias("last_ingestion_at"),
        F.min("published_at").alias("oldest_source_date"), F.max("published_at").alias("newest_source_date"))
    chunk_stats = chunks.agg(F.count("*").alias("total_chunks"))
    asked = F.col("role") == "user"
    message_stats = messages.agg(
        F.count("*").alias("total_messages"),
        F.count_if(asked & (F.col("created_at") >= day_start(now))).alias("queries_today"),
        F.count_if(asked & (F.col("created_at") >= week_start(now))).alias("queries_this_week"))
    dispute_stats = dispute_status_counts(disputes)
    dispute_stats = dispute_stats.select(F.col("total").alias("total_disputes"), *[
        F.col(s).alias(f"disputes_{s}") for s in fv.DISPUTE_STATUSES])
    user_stats = users.agg(F.count("*").alias("unique_citizens"))
    return one_row(source_stats, chunk_stats, message_stats, dispute_stats, user_stats)


def query_volume(messages: DataFrame, unit: str = "day") -> DataFrame:
    """User questions per day or Monday-based week."""
    return (messages.where(F.col("role") == "user").groupBy(F.date_trunc(unit, "created_at").alias("start"))
            .agg(F.count("*").alias("queries")))
