"""Explicit schemas of the tables the jobs read and write."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_L, _S, _B, _TS, _I, _D = (T.LongType(), T.StringType(), T.BooleanType(), T.TimestampType(),
                           T.IntegerType(), T.DoubleType())

PASSAGE = _struct(("source_title", _S, True), ("page_number", _I, True),
                  ("government_arm", _S, True), ("chunk_text", _S, True))
HISTORY_TURN = _struct(("role", _S, True), ("text", _S, True))

PAGES = _struct(("source", _S, False), ("page", _I, False), ("text", _S, True))
CORPUS = _struct(("chunk_id", _S, False), ("source", _S, False), ("page", _I, False), ("text", _S, False))
USERS = _struct(("id", _L, False), ("hashed_wa_id", _S, False), ("created_at", _TS, True),
                ("last_active_at", _TS, True))
SESSIONS = _struct(("id", _L, False), ("user_id", _L, False), ("is_active", _B, False),
                   ("pending_dispute_message_id", _L, True), ("created_at", _TS, False))
MESSAGES = _struct(("id", _L, False), ("session_id", _L, False), ("role", _S, False), ("text", _S, False),
                   ("citation", _S, True), ("retrieved_chunks", T.ArrayType(PASSAGE), True),
                   ("created_at", _TS, False))
DISPUTES = _struct(("id", _L, False), ("message_id", _L, False), ("reported_by_user_id", _L, False),
                   ("reason", _S, True), ("status", _S, False), ("report_count", _L, False),
                   ("flagged_for_review", _B, False), ("reviewed_by", _S, True), ("reviewed_at", _TS, True),
                   ("resolution_note", _S, True), ("escalation_report", _S, True), ("created_at", _TS, False))
SOURCES = _struct(("id", _L, False), ("url", _S, False), ("title", _S, False), ("publisher", _S, False),
                  ("government_arm", _S, False), ("county", _S, False), ("report_type", _S, False),
                  ("fiscal_year", _S, True), ("published_at", _TS, True), ("last_scraped_at", _TS, True),
                  ("ingestion_status", _S, False), ("ingestion_error", _S, True), ("content_hash", _S, True),
                  ("created_at", _TS, False))
CHUNKS = _struct(("id", _L, False), ("source_id", _L, False), ("government_arm", _S, False),
                 ("county", _S, False), ("chunk_text", _S, False), ("embedding", T.ArrayType(T.FloatType()), True),
                 ("page_number", _I, False), ("chunk_index", _I, False), ("created_at", _TS, True))
VALIDATIONS = _struct(("id", _L, False), ("message_id", _L, False), ("tone_score", _I, False),
                      ("grounded", _B, False), ("register", _S, False), ("reviewer", _S, True),
                      ("notes", _S, True), ("created_at", _TS, True))
EVENTS = _struct(("event_id", _L, True), ("ts", T.TimestampNTZType(), True), ("user_id", _L, True),
                 ("event_type", _S, True), ("value", _D, True), ("props", _S, True))
CONVERSATIONS = _struct(("conv_id", _L, True), ("turn", _L, True), ("role", _S, True), ("text", _S, True))
DOCUMENTS = _struct(("doc_id", _L, True), ("text", _S, True), ("lang", _S, True), ("source", _S, True), ("n_chars", _L, True))
TABLES = {
    "users": USERS, "sessions": SESSIONS, "messages": MESSAGES, "disputes": DISPUTES,
    "sources": SOURCES, "chunks": CHUNKS, "validations": VALIDATIONS,
}
