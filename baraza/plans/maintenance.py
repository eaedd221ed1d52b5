"""Table maintenance as change-set jobs: edits, deletes, upserts, outcome roll-ups and retention."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baraza import fixed_values as fv
from baraza.operators.grouped import last_per_key
from baraza.operators.topk import page_of
from baraza.plans.quality import one_row

EDITABLE = ["url", "title", "publisher", "government_arm", "county", "report_type", "fiscal_year"]
IDENTITY = ["url", "government_arm", "report_type"]


def filter_sources(sources: DataFrame, **wanted) -> DataFrame:
    """Sources matching every given value; ``serialise.source_rows`` puts the newest first."""
    for column, value in wanted.items():
        if value is not None:
            sources = sources.where(F.col(column) == value)
    return sources


def source_page(sources: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the source list, newest first; its total is ``topk.page_total`` of ``sources``."""
    return page_of(sources, [F.desc("created_at"), F.asc("id")], limit, offset)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(F.count("*").alias("chunk_count"))


def edit_sources(sources: DataFrame, chunks: DataFrame, edits: DataFrame, sequence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply edits (``id`` plus any editable column, null = keep): ``(sources, chunks)`` after.

    Of several edits of a source the last by ``sequence`` counts, as a whole.

    A new url, arm or report type invalidates the source's chunks and sends it back to ``pending``.
    """
    given = [c for c in EDITABLE if c in edits.columns]
    renamed = last_per_key(edits, ["id"], sequence).select("id", *[F.col(c).alias(f"_{c}") for c in given])
    joined = sources.join(renamed, "id", "left")
    changed = F.lit(False)
    for c in IDENTITY:
        if c in given:
            changed = changed | (F.col(f"_{c}").isNotNull() & (F.col(f"_{c}") != F.col(c)))
    flagged = joined.withColumn("_reset", F.coalesce(changed, F.lit(False)))
    edited = flagged.withColumns({c: F.coalesce(f"_{c}", c) for c in given}).withColumns({
        "ingestion_status": F.when(F.col("_reset"), "pending").otherwise(F.col("ingestion_status")),
        "last_scraped_at": F.when(~F.col("_reset"), F.col("last_scraped_at")),
        "ingestion_error": F.when(~F.col("_reset"), F.col("ingestion_error"))})
    stale = flagged.where("_reset").select(F.col("id").alias("source_id"))
    return edited.select(*sources.columns), chunks.join(stale, "source_id", "left_anti")


def delete_sources(sources: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete sources with their chunks: ``(sources, chunks, outcome per id)``; busy sources are refused."""
    asked = ids.select("id").distinct()
    state = asked.join(sources.select("id", "ingestion_status"), "id", "left")
    verdict = (F.when(F.col("ingestion_status").isNull(), "not_found")
               .when(F.col("ingestion_status") == "in_progress", "in_progress").otherwise("deleted"))
    judged = state.select("id", verdict.alias("outcome"))
    gone = judged.where(F.col("outcome") == "deleted").select("id")
    counts = chunk_counts(chunks).withColumnRenamed("source_id", "id")
    removed = F.when(F.col("outcome") == "deleted", F.coalesce("chunk_count", F.lit(0))).otherwise(0)
    outcome = judged.join(counts, "id", "left").select("id", "outcome", removed.alias("chunks_deleted"))
    return (sources.join(gone, "id", "left_anti"),
            chunks.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti"), outcome)


def upsert_sources(sources: DataFrame, incoming: DataFrame, now: Column, keys=("url", "title"), sequence: str | None = None) -> DataFrame:
    """Register documents: known ``keys`` get the new details, unknown ones arrive as ``pending`` without id.

    Of several rows of a key the last by ``sequence`` counts.
    """
    details = [c for c in EDITABLE if c in incoming.columns and c not in keys]
    fresh = last_per_key(incoming, keys, sequence).select(*keys, *[F.col(c).alias(f"_{c}") for c in details], F.lit(True).alias("_new"))
    joined = sources.join(fresh, list(keys), "full")
    missing = F.col("ingestion_status").isNull()
    merged = joined.withColumns({c: F.coalesce(f"_{c}", c) for c in details}).withColumns({
        "created_at": F.when(missing, now).otherwise(F.col("created_at")),
        "ingestion_status": F.coalesce("ingestion_status", F.lit("pending"))})
    return merged.select(*sources.columns)


def roll_up_outcomes(sources: DataFrame, outcomes: DataFrame, now: Column, sequence: str | None = None) -> DataFrame:
    """Write ingestion outcomes (``source_id, status, error, content_hash``) back to the sources; of several the last counts."""
    result = last_per_key(outcomes, ["source_id"], sequence).select(F.col("source_id").alias("id"), F.col("status").alias("_status"),
                             F.left("error", F.lit(fv.MAX_ERROR_CHARS)).alias("_error"), F.col("content_hash").alias("_hash"))
    done = F.col("_status").isNotNull()
    joined = sources.join(result, "id", "left").withColumns({
        "ingestion_status": F.coalesce("_status", "ingestion_status"),
        "ingestion_error": F.when(done, F.col("_error")).otherwise(F.col("ingestion_error")),
        "last_scraped_at": F.when(done, now).otherwise(F.col("last_scraped_at")),
        "content_hash": F.coalesce("_hash", "content_hash")})
    return joined.select(*sources.columns)


def outcome_tally(outcomes: DataFrame) -> DataFrame:
    """Counts per outcome status."""
    return outcomes.groupBy("status").agg(F.count("*").alias("cnt"))


def failed_outcomes(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("status") != "completed")


def retention_cutoffs(now: Column, message_days: int, dispute_days: int) -> tuple[Column, Column]:
    return now - F.make_dt_interval(F.lit(message_days)), now - F.make_dt_interval(F.lit(dispute_days))


def retain(messages: DataFrame, disputes: DataFrame, now: Column, message_days: int = fv.MESSAGE_RETENTION_DAYS,
           dispute_days: int = fv.DISPUTE_RETENTION_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(messages kept, disputes kept, report)``: disputes expire first, then unreferenced old messages.

    The report is the dry run: cut-offs and the number of rows each table loses.
    """
    message_cutoff, dispute_cutoff = retention_cutoffs(now, message_days, dispute_days)
    kept_disputes = disputes.where(F.col("created_at") >= dispute_cutoff)
    referenced = kept_disputes.select(F.col("message_id").alias("id")).distinct().withColumn("_referenced", F.lit(True))
    flagged = messages.join(referenced, "id", "left")
    expired = (F.col("created_at") < message_cutoff) & F.col("_referenced").isNull()
    kept_messages = flagged.where(~expired).select(*messages.columns)
    report = one_row(
        disputes.agg(F.count_if(F.col("created_at") < dispute_cutoff).alias("disputes_deleted")),
        flagged.agg(F.count_if(expired).alias("messages_deleted")))
    return kept_messages, kept_disputes, report.withColumns(
        {"message_cutoff": message_cutoff, "dispute_cutoff": dispute_cutoff})
