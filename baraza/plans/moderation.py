"""Report moderation: the queue per answer, decisions, and escalation records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baraza import fixed_values as fv
from baraza.functions.serialise import iso
from baraza.operators.grouped import counts_by_value, earliest_per_group, last_per_key
from baraza.operators.topk import page_of
from baraza.plans.answers import read_snapshot
from baraza.plans.conversations import with_preceding


def dispute_queue(disputes: DataFrame, status: str | None = None, flagged: bool | None = None) -> DataFrame:
    """One row per disputed answer - its earliest report - with the time of its latest report."""
    grouped = earliest_per_group(disputes, ["message_id"], "id", "created_at", "last_reported_at")
    if status is not None:
        grouped = grouped.where(F.col("status") == status)
    if flagged is not None:
        grouped = grouped.where(F.col("flagged_for_review") == flagged)
    return grouped


def dispute_page(disputes: DataFrame, limit: int = 50, offset: int = 0, status: str | None = None,
                 flagged: bool | None = None) -> DataFrame:
    return page_of(dispute_queue(disputes, status, flagged), [F.desc("last_reported_at"), F.asc("id")], limit, offset)


def dispute_context(queue: DataFrame, messages: DataFrame) -> DataFrame:
    """Add the disputed answer, the question before it and the passages stored with it (``passages``, none without a snapshot)."""
    asked = messages.join(queue.select(F.col("message_id").alias("id")).distinct(), "id", "left_semi").select("session_id").distinct()
    questions = with_preceding(messages.join(asked, "session_id", "left_semi"))
    answers = questions.select(F.col("id").alias("message_id"), F.col("role").alias("answer_role"),
                               F.col("text").alias("answer_text"), "citation", read_snapshot(F.col("retrieved_chunks")).alias("passages"),
                               "question")
    return queue.join(answers, "message_id", "left")


def queue_label(status: Column, flagged: Column) -> Column:
    waiting = (status == "pending_review") & ~F.coalesce(flagged, F.lit(False))
    return F.when(waiting, "awaiting_more_reports").otherwise(status)


def dispute_status_counts(disputes: DataFrame) -> DataFrame:
    """Counts of answers by the status of their earliest report, all statuses present, plus the total."""
    reps = disputes.groupBy("message_id").agg(F.min_by("status", "id").alias("status"))
    return reps.agg(F.count("*").alias("total"), *counts_by_value(F.col("status"), fv.DISPUTE_STATUSES, ""))


def transition_error(current: Column, new: Column, correction: Column) -> Column:
    """Why a decision is refused, or null if it is legal."""
    allowed = F.create_map(*[x for s, nexts in fv.DISPUTE_TRANSITIONS.items() for x in (
        F.lit(s), F.array(*[F.lit(n) for n in nexts]).cast("array<string>"))])
    legal = F.coalesce(F.array_contains(F.element_at(allowed, current), new), F.lit(False)) | (new == current)
    has_correction = correction.isNotNull() & (correction != "")
    return (F.when(~new.isin(fv.DISPUTE_STATUSES), "unknown_status").when(~legal, "invalid_transition")
            .when(has_correction & ~new.isin(fv.RESOLVED_STATUSES), "correction_not_allowed"))


def escalation_record(dispute_id: Column, generated_at: Column, recipient: Column, answer: Column, citation: Column,
                      passages: Column, reason: Column, note: Column) -> Column:
    """The anonymised record for an outside authority, as JSON text."""
    content = F.struct(F.left(answer, F.lit(fv.MAX_ERROR_CHARS)).alias("disputed_answer"), citation.alias("citation"),
                       passages.alias("retrieved_passages"), reason.alias("citizen_report"), note.alias("moderator_note"))
    record = F.struct(dispute_id.alias("dispute_id"), generated_at.alias("generated_at"),
                      F.coalesce(recipient, F.lit("(not specified)")).alias("recipient"), content.alias("content"))
    return F.to_json(record, {"ignoreNullFields": "false"})


def apply_decisions(disputes: DataFrame, decisions: DataFrame, messages: DataFrame, now: Column,
                    sequence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply moderator decisions: ``(disputes after, outcome per decision)``.

    ``decisions`` has ``dispute_id, new_status, resolution_note, correction_message, recipient``; of several decisions of one
    dispute the last by ``sequence`` counts, and of several legal ones of one answer that of the largest dispute id.
    A legal decision is written to every report row of its answer.
    """
    target = disputes.select(F.col("id").alias("dispute_id"), "message_id", F.col("status").alias("old_status"),
                             "reason", F.col("resolution_note").alias("old_note"))
    judged = last_per_key(decisions, ["dispute_id"], sequence).join(target, "dispute_id", "left")
    error = F.when(F.col("message_id").isNull(), "not_found").otherwise(
        transition_error(F.col("old_status"), F.col("new_status"), F.col("correction_message")))
    answers = messages.select(F.col("id").alias("message_id"), F.col("text").alias("_answer"),
                              F.col("citation").alias("_citation"), F.col("retrieved_chunks").alias("_passages"))
    judged = judged.withColumn("error", error).join(answers, "message_id", "left")
    # An empty note leaves the stored one in place.
    note = F.coalesce(F.nullif("resolution_note", F.lit("")), "old_note")
    record = F.when(F.col("error").isNull() & (F.col("new_status") == "escalated"), escalation_record(
        F.col("dispute_id"), iso(now), F.col("recipient"), F.col("_answer"), F.col("_citation"), F.col("_passages"),
        F.col("reason"), note))
    outcomes = judged.select("dispute_id", "message_id", "old_status", "new_status", F.col("error").isNull().alias("ok"),
                             "error", F.nullif("resolution_note", F.lit("")).alias("note"), record.alias("record"))
    accepted = last_per_key(outcomes.where("ok"), ["message_id"], "dispute_id").select("message_id", F.col("new_status").alias("_status"),
                                           F.col("note").alias("_note"), F.col("record").alias("_record"))
    changed = F.col("_status").isNotNull()
    updated = disputes.join(accepted, "message_id", "left").withColumns({
        "status": F.coalesce("_status", "status"),
        "reviewed_by": F.when(changed, "moderator").otherwise(F.col("reviewed_by")),
        "reviewed_at": F.when(changed, now).otherwise(F.col("reviewed_at")),
        "resolution_note": F.coalesce("_note", "resolution_note"),
        "escalation_report": F.coalesce("_record", "escalation_report")})
    return updated.select(*disputes.columns), outcomes.drop("note", "record")
