"""Conversation history, as-of lookups, the two-step report labels and the session browser."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baraza import fixed_values as fv
from baraza.functions.identity import canonical_number, pseudonym
from baraza.functions.text import is_report_keyword
from baraza.operators.ordered import BLOCK, forward_fill, previous_row, previous_rows
from baraza.operators.topk import page_of


def incoming(posts: DataFrame, secret: bytes) -> DataFrame:
    """Provider posts to messages: one sender and body column, empty ones dropped, sender pseudonymised.

    ``posts`` may carry ``WaId, From, Body`` (one provider) or ``from_number, text`` (the other).
    """
    other = F.col("Body").isNotNull()
    sender = canonical_number(F.when(other, F.coalesce(F.nullif("WaId", F.lit("")), F.col("From")))
                              .otherwise(F.col("from_number")))
    body = F.when(other, F.col("Body")).otherwise(F.col("text"))
    kept = [c for c in posts.columns if c not in ("WaId", "From", "Body", "from_number", "text")]
    return (posts.select(*kept, sender.alias("_sender"), body.alias("text"))
            .where((F.col("_sender") != "") & F.col("text").isNotNull() & (F.col("text") != ""))
            .withColumn("hashed_wa_id", pseudonym(F.col("_sender"), secret)).drop("_sender"))


def with_history(messages: DataFrame, limit: int = fv.HISTORY_LIMIT, block: int = BLOCK) -> DataFrame:
    """Add ``history``: up to ``limit`` preceding user and assistant turns of the session, oldest first."""
    turns = messages.where(F.col("role").isin("user", "assistant"))
    return previous_rows(turns, ["session_id"], "id", F.struct("role", "text"), "history", limit, block=block)


def with_preceding(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``question`` (latest earlier user text) and ``last_answer_id`` (latest earlier assistant id)."""
    return forward_fill(messages, ["session_id"], "id", {
        "question": F.when(F.col("role") == "user", F.col("text")),
        "last_answer_id": F.when(F.col("role") == "assistant", F.col("id")),
    }, inclusive=False, block=block)


def report_labels(messages: DataFrame, is_report: Column | None = None, block: int = BLOCK) -> DataFrame:
    """User messages with ``action`` and ``target_message_id`` of the two-step report dialogue.

    A keyword prompts for a reason (or finds no answer to report); the next other message files it.
    """
    keyword = is_report if is_report is not None else is_report_keyword(F.col("text"))
    answered = with_preceding(messages, block).where(F.col("role") == "user").drop("question")
    marked = answered.withColumn("is_report", keyword)
    pending = F.when(F.col("is_report"), F.col("last_answer_id"))
    lagged = previous_row(marked, ["session_id"], "id", pending, "_pending", block=block)
    filing = ~F.col("is_report") & F.col("_pending").isNotNull()
    action = (F.when(F.col("is_report") & F.col("last_answer_id").isNull(), "no_answer")
              .when(F.col("is_report"), "prompt_reason").when(filing, "file_reason").otherwise("question"))
    return lagged.withColumn("action", action).withColumn(
        "target_message_id", F.when(filing, F.col("_pending"))).drop("_pending", "is_report")


def active_sessions(sessions: DataFrame) -> DataFrame:
    """The newest active session per user."""
    newest = sessions.where("is_active").groupBy("user_id").agg(
        F.max_by(F.struct("id", "created_at"), F.struct("created_at", "id")).alias("s"))
    return newest.select("user_id", F.col("s.id").alias("session_id"), F.col("s.created_at").alias("created_at"))


def upsert_users(users: DataFrame, messages: DataFrame) -> DataFrame:
    """Users after a batch of messages (``hashed_wa_id, created_at``): new identities added, activity moved on."""
    seen = messages.groupBy("hashed_wa_id").agg(F.min("created_at").alias("_first"), F.max("created_at").alias("_last"))
    return users.join(seen, "hashed_wa_id", "full").select(
        "id", "hashed_wa_id", F.coalesce("created_at", "_first").alias("created_at"),
        F.greatest("last_active_at", "_last").alias("last_active_at"))


def session_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"), F.min("created_at").alias("first_message_at"),
        F.max("created_at").alias("last_message_at"))


def session_browser(sessions: DataFrame, messages: DataFrame, is_active: bool | None = None) -> DataFrame:
    """Every session with message count and span; sessions without messages fall back to their creation time."""
    chosen = sessions if is_active is None else sessions.where(F.col("is_active") == is_active)
    stats = session_stats(messages).withColumnRenamed("session_id", "id")
    return chosen.join(stats, "id", "left").select(
        "id", "user_id", "is_active", F.coalesce("message_count", F.lit(0)).alias("message_count"),
        F.coalesce("first_message_at", "created_at").alias("first_message_at"),
        F.coalesce("last_message_at", "created_at").alias("last_message_at"), "created_at",
        F.col("last_message_at").alias("latest"))


def session_page(sessions: DataFrame, messages: DataFrame, limit: int = 20, offset: int = 0,
                 is_active: bool | None = None) -> DataFrame:
    """A page of sessions, most recently active first, silent sessions last."""
    browsed = session_browser(sessions, messages, is_active)
    return page_of(browsed, [F.col("latest").desc_nulls_last(), F.asc("id")], limit, offset).drop("latest")


def message_page(messages: DataFrame, limit: int = 20, offset: int = 0, session_id: int | None = None) -> DataFrame:
    chosen = messages if session_id is None else messages.where(F.col("session_id") == session_id)
    return page_of(chosen, [F.asc("created_at"), F.asc("id")], limit, offset)
