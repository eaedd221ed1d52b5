"""The model tables as they are derived from the given Parquet tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baraza import fixed_values as fv
from baraza.functions.text import literal_map


_WIDE = {"documents": ["doc_id"], "pages": ["page_id"], "embeddings": ["vec_id"], "conversations": ["conv_id", "turn"]}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. A text or vector table stored in fewer splits than there are cores is spread by its id,
    so the per-row work on it runs in parallel; a table of many files is read as it is.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _WIDE and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, *_WIDE[name])
    return df


def pick(values: list[str], number) -> F.Column:
    """Element ``number mod len`` of a constant list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def pages(spark, sf) -> DataFrame:
    """Documents as one page each."""
    return table(spark, sf, "documents").select("source", F.col("doc_id").alias("page"), "text")


def messages(spark, sf, raw: DataFrame | None = None) -> DataFrame:
    """Conversation turns as messages; ``raw`` may be the same rows as a stream."""
    c = table(spark, sf, "conversations") if raw is None else raw
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.col("conv_id").cast("int"), F.col("turn").cast("int"))
    number = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(
        number.alias("id"), F.col("conv_id").alias("session_id"), "role", "text",
        F.when(F.col("role") == "assistant", F.concat(F.lit("report, page "), F.col("turn").cast("string"))).alias("citation"),
        at.alias("created_at"))


def disputes(spark, sf, raw: DataFrame | None = None) -> DataFrame:
    """Error events as reports of answers; one status stays unused. ``raw`` may be the same rows as a stream."""
    k = F.get_json_object("props", "$.k").cast("long")
    used = ["pending_review", "under_review", "resolved_valid", "escalated"]
    events = table(spark, sf, "events") if raw is None else raw
    return events.where(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"), ((k + 5) * 1000 + 1).alias("message_id"),
        F.col("user_id").alias("reported_by_user_id"),
        F.concat(F.lit("reason "), F.col("event_id").cast("string")).alias("reason"),
        pick(used, F.col("event_id")).alias("status"), F.lit(1).cast("long").alias("report_count"),
        F.lit(False).alias("flagged_for_review"), F.lit(None).cast("string").alias("reviewed_by"),
        F.lit(None).cast("timestamp_ntz").alias("reviewed_at"), F.lit(None).cast("string").alias("resolution_note"),
        F.lit(None).cast("string").alias("escalation_report"), F.col("ts").alias("created_at"))


def sources(spark, sf) -> DataFrame:
    """One row per distinct document source; one ingestion status stays unused."""
    base = table(spark, sf, "documents").groupBy("source").agg(
        F.min("doc_id").alias("first_doc"), F.max("lang").alias("publisher"), F.count("*").alias("n"))
    sid = F.regexp_extract("source", r"(\d+)$", 1).cast("long")
    epoch = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")

    def after(days):
        return epoch + F.make_dt_interval(days.cast("int"))

    return base.select(
        sid.alias("id"), F.concat(F.lit("https://docs.example.org/"), F.col("source")).alias("url"),
        F.col("source").alias("title"), "publisher", pick(fv.GOVERNMENT_ARMS, sid).alias("government_arm"),
        pick(["nakuru", "nandi", "meru"], sid).alias("county"), pick(fv.REPORT_TYPES, sid).alias("report_type"),
        pick(["2022/23", "2023/24"], sid).alias("fiscal_year"),
        F.when(sid % 7 != 0, after(F.col("first_doc"))).alias("published_at"),
        F.when(sid % 3 != 0, after(F.col("n"))).alias("last_scraped_at"),
        pick(["completed", "pending", "in_progress"], sid).alias("ingestion_status"),
        F.when(sid % 5 == 0, F.lit("timeout")).alias("ingestion_error"), F.lit(None).cast("string").alias("content_hash"),
        after(sid).alias("created_at"))


def chunk_sources(chunks: DataFrame) -> DataFrame:
    """Chunks keyed by the number inside their source name."""
    return chunks.withColumn("source_id", F.regexp_extract("source", r"(\d+)$", 1).cast("long"))


def validations(spark, sf) -> DataFrame:
    labels = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    register = literal_map({"en": "english", "fr": "formal_swahili", "de": "sheng"})
    return labels.select(
        F.col("doc_id").alias("id"), (F.col("doc_id") * 1000 + 1).alias("message_id"),
        (1 + 4 * F.col("quality")).cast("long").alias("tone_score"), (F.col("toxic") == 0).alias("grounded"),
        F.coalesce(F.try_element_at(register, F.col("lang")), F.lit("other")).alias("register"))


def listing_sources(spark, sf) -> DataFrame:
    """One source per web page, titled by the page, for link scoring."""
    p = table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("source_id"), F.col("url").alias("listing_url"),
                    F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"),
                    pick(fv.GOVERNMENT_ARMS, F.col("page_id")).alias("government_arm"),
                    pick(fv.REPORT_TYPES, F.col("page_id")).alias("report_type"))


def blocks(spark, sf) -> DataFrame:
    """Order lines as positioned text blocks, an order being a page."""
    l = table(spark, sf, "lineitem")
    x0, y0 = F.col("l_quantity").cast("double"), (F.col("l_partkey") % 40).cast("double")
    return l.select(
        (F.col("l_orderkey") % 97).alias("source"), F.col("l_orderkey").alias("page"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 4).alias("x1"), (y0 + 2).alias("y1"), F.col("l_linenumber").cast("long").alias("seq"),
        F.concat_ws(" ", "l_returnflag", F.col("l_partkey").cast("string")).alias("text"))


def ruled_tables(spark, sf) -> DataFrame:
    """Orders as one ruled table per page."""
    o = table(spark, sf, "orders")
    x0, y0 = (F.col("o_custkey") % 30).cast("double"), (F.col("o_custkey") % 20).cast("double")
    return o.select(
        (F.col("o_orderkey") % 97).alias("source"), F.col("o_orderkey").alias("page"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 15).alias("x1"), (y0 + 10).alias("y1"), F.lit(1).cast("long").alias("seq"),
        F.concat(F.lit("|"), F.col("o_orderstatus"), F.lit("<br>"), F.col("o_orderpriority"), F.lit("|")).alias("text"))
