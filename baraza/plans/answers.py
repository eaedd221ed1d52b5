"""Finishing supplied answer texts: marker parsing, citations, labels and snapshots."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baraza import fixed_values as fv
from baraza.functions import text as tx

MARKER = f"(?dim){fv.MARKER_LINE}"
CITATION_LINE = f"(?dim){fv.CITATION_LINE}"


def marker(raw: Column) -> Column:
    """``none``, a list of numbers, or null without a marker line."""
    return F.when(raw.rlike(MARKER), F.lower(F.regexp_extract(raw, MARKER, 1)))


def answer_text(raw: Column) -> Column:
    """The answer without marker and citation lines."""
    return tx.strip(F.regexp_replace(F.regexp_replace(raw, MARKER, ""), CITATION_LINE, ""))


def cited_rank(raw: Column) -> Column:
    """1-based rank of the cited hit: the first number named, the first hit without a marker, else null."""
    named = marker(raw)
    first = F.regexp_extract(named, r"\d+", 0)
    return F.when(named.isNull(), 1).when(named == "none", F.lit(None)).otherwise(first.try_cast("int"))


def citation(title: Column, source_id: Column, page: Column) -> Column:
    named = F.when(title.isNotNull() & (title != ""), title).otherwise(F.concat(F.lit("source "), source_id.cast("string")))
    return F.concat(named, F.lit(", page "), page.cast("string"))


def snapshot(hits: Column) -> Column:
    """The four fields kept of each hit, as JSON text; null without hits."""
    kept = F.transform(hits, lambda h: F.struct(*[h[f].alias(f) for f in (
        "source_title", "page_number", "government_arm", "chunk_text")]))
    return F.when(F.size(hits) > 0, F.to_json(kept, {"ignoreNullFields": "false"}))


def read_snapshot(json: Column) -> Column:
    from baraza.schemas import PASSAGE
    from pyspark.sql import types as T

    return F.coalesce(F.from_json(json, T.ArrayType(PASSAGE)), F.array().cast(T.ArrayType(PASSAGE)))


def labelled_reply(text: Column, cited: Column) -> Column:
    """The reply with its citation line, labelled in the reply's language."""
    label = F.when(tx.reply_language(text) == "sw", "Chanzo").otherwise("Source")
    line = F.concat(F.lit(f"\n\n{fv.CITATION_ICON} "), label, F.lit(": "), cited)
    return F.when(cited != fv.NOT_AVAILABLE, F.concat(text, line)).otherwise(text)


def finish_answers(raw: DataFrame, hits: DataFrame) -> DataFrame:
    """``raw`` (``query_id, raw_text``) with hits (``query_id, hits``) to finished, storable answers."""
    joined = raw.join(hits, "query_id", "left")
    cited = F.try_element_at("hits", F.greatest(cited_rank(F.col("raw_text")), F.lit(1)))
    in_range = cited_rank(F.col("raw_text")).between(1, F.size("hits"))
    found = F.when(in_range, citation(cited["source_title"], cited["source_id"], cited["page_number"]))
    return joined.select(
        "query_id", answer_text(F.col("raw_text")).alias("text"),
        F.coalesce(found, F.lit(fv.NOT_AVAILABLE)).alias("citation"), F.lit(fv.NOT_AVAILABLE).alias("last_updated"),
        snapshot(F.col("hits")).alias("retrieved_chunks"),
    ).withColumn("reply", labelled_reply(F.col("text"), F.col("citation")))
