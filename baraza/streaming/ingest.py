"""Continuous ingestion of arriving pages."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baraza import fixed_values as fv
from baraza.functions.text import chunk_id, heading_county, strip, word_windows
from baraza.plans.corpus import chosen_pages, described_chunks, ingest_outcomes
from baraza.session import run_folder
from baraza.streaming.running import run_batches
from baraza.streaming.versioned import Versioned

#: One row for each page that has arrived: what decides about it, and its chunks.
PARSED = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("page", T.LongType()), T.StructField("n_chars", T.IntegerType()),
    T.StructField("heading", T.StringType()), T.StructField("chunks", T.ArrayType(T.StringType()))])


def parsed_pages(pages: DataFrame, heading=None, size: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """Pages (``source, page, text``) as rows of ``PARSED``; of several rows of one page the largest counts."""
    found = heading if heading is not None else heading_county(F.col("text"))
    row = F.struct("text", *[c for c in pages.columns if c not in ("source", "page", "text")])
    once = pages.groupBy("source", F.col("page").cast("long").alias("page")).agg(F.max(row).alias("row")).select("source", "page", "row.*")
    trimmed = once.withColumn("text", strip(F.col("text")))
    readable = F.length("text") >= fv.MIN_PAGE_CHARS
    return trimmed.select("source", "page", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), F.when(readable, found).alias("heading"),
                          F.when(readable, word_windows(F.col("text"), size, overlap)).otherwise(F.array().cast("array<string>")).alias("chunks"))


def ingested(parsed: DataFrame, sources: DataFrame, county: str, *, embed: Callable[[DataFrame], DataFrame] | None = None,
             first_pages: int = fv.TEXT_LAYER_PAGES, layer_chars: int = fv.MIN_PAGE_CHARS) -> tuple[DataFrame, DataFrame]:
    """``(chunks, outcomes)`` of a table of parsed pages: screen, section and numbers are decided on narrow rows when it is read."""
    spark = parsed.sparkSession
    folder = run_folder(spark, "ingested")
    parsed.select("source", "page", "n_chars", "heading", F.size("chunks").cast("long").alias("n_chunks")).write.parquet(f"{folder}/facts")
    chosen, layers = chosen_pages(spark.read.parquet(f"{folder}/facts"), county, first_pages=first_pages, layer_chars=layer_chars)
    chosen.write.parquet(f"{folder}/chosen")
    chosen = spark.read.parquet(f"{folder}/chosen")
    cut = parsed.select("source", "page", "chunks").join(chosen, ["source", "page"]).select(
        "source", "page", "before", F.posexplode("chunks").alias("chunk_no", "text"))
    cut = cut.select(chunk_id(F.col("source"), F.col("page"), F.col("chunk_no")).alias("chunk_id"), "source", "page",
                     (F.col("before") + F.col("chunk_no")).alias("chunk_index"), "text")
    return described_chunks(cut, sources, embed), ingest_outcomes(chosen, layers, sources, county)


def ingest_arrivals(pages: DataFrame, sources: DataFrame, county: str, folder: str, checkpoint: str, *,
                    embed: Callable[[DataFrame], DataFrame] | None = None, size: int = fv.CHUNK_WORDS,
                    overlap: int = fv.CHUNK_OVERLAP, first_pages: int = fv.TEXT_LAYER_PAGES,
                    layer_chars: int = fv.MIN_PAGE_CHARS, heading=None) -> tuple[DataFrame, DataFrame]:
    """``(chunks, outcomes)`` of everything that has arrived: ``pages`` has ``source, page, text``.

    A micro-batch parses the pages it brings and enters them as changes of a versioned table of pages, so its work follows the batch
    and not what came before. A page may come in any batch; one that comes again replaces its earlier text. Which pages count, and the
    chunk numbers of a source, follow from all its pages when the table is read: a source that yields nothing ends with no
    chunk. Pages of unknown sources are kept and give nothing until their source is known.
    """
    table = Versioned(pages.sparkSession, folder, PARSED, ["source", "page"])
    run_batches(pages, checkpoint, lambda batch, number: table.commit(number, parsed_pages(batch, heading, size, overlap)))
    return ingested(table.read(), sources, county, embed=embed, first_pages=first_pages, layer_chars=layer_chars)
