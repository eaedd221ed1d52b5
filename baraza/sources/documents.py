"""Documents, pages and chunks: scans, screens and sinks."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baraza import fixed_values as fv
from baraza import schemas
from baraza.functions.text import strip
from baraza.sources.manifest import Manifest


def trimmed_length(text):
    return F.length(strip(text))


def readable_pages(pages: DataFrame, min_chars: int = fv.MIN_PAGE_CHARS) -> DataFrame:
    """Pages with at least ``min_chars`` characters of trimmed text; the text comes back trimmed."""
    return pages.withColumn("text", strip(F.col("text"))).where(F.length("text") >= min_chars)


def text_layer(pages: DataFrame, first_pages: int = fv.TEXT_LAYER_PAGES,
               min_chars: int = fv.MIN_PAGE_CHARS) -> DataFrame:
    """``(source, has_text)``: does one of the first pages hold readable text (else it is a scan)?

    ``pages`` has ``source``, the page's ``number`` in its source from 0 (``operators.numbered``) and its trimmed length ``n_chars``.
    """
    first = pages.where(F.col("number") < first_pages)
    return first.groupBy("source").agg(F.bool_or(F.col("n_chars") >= min_chars).alias("has_text"))


def read_binary_documents(spark: SparkSession, path: str, max_bytes: int = fv.MAX_DOCUMENT_BYTES) -> DataFrame:
    """``(path, bytes, content_hash, ok, error)`` per file: size cap and ``%PDF`` signature checked.

    The size comes from the file listing; files above the cap are rejected without being read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = listed.where(F.col("length") <= max_bytes).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("content_hash"),
        (F.hex(F.substring("content", 1, 4)) == "25504446").alias("_pdf"))
    large = listed.where(F.col("length") > max_bytes).select("path", F.col("length").alias("bytes"))
    checked = small.select(
        "path", "bytes", F.when(F.col("_pdf"), F.col("content_hash")).alias("content_hash"),
        F.col("_pdf").alias("ok"), F.when(~F.col("_pdf"), "not a PDF").alias("error"))
    rejected = large.select("path", "bytes", F.lit(None).cast("string").alias("content_hash"),
                            F.lit(False).alias("ok"), F.lit("exceeds maximum size").alias("error"))
    return checked.unionByName(rejected)


def write_corpus_json(chunks: DataFrame, path: str) -> None:
    chunks.select(*schemas.CORPUS.fieldNames()).write.mode("overwrite").json(path)


def read_corpus_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CORPUS).json(path)


def replace_chunks(chunks: DataFrame, path: str, sources: DataFrame | None = None) -> None:
    """Make ``chunks`` the chunks of their sources in the sink ``path``; other sources keep theirs.

    ``sources`` (``source_id``) are cleared as well, so one that yields no chunk ends empty. A replacement is two tables - rows, and the
    sources it speaks for - written under a new number and entered in the manifest at the end: readers see the old chunks of a source
    until they see all of its new ones. Rows are dealt by size, many small sources to a file and a large one over several.
    """
    manifest = Manifest(chunks.sparkSession, path)
    number = max((int(n) for n in manifest.entries()), default=-1) + 1
    folder = f"{path}/part-{number}"
    chunks.hint("rebalance", "source_id").sortWithinPartitions("source_id").write.mode("overwrite").parquet(f"{folder}/chunks")
    spoken = chunks.sparkSession.read.parquet(f"{folder}/chunks").select("source_id").distinct()
    if sources is not None:
        spoken = spoken.union(sources.select("source_id")).distinct()
    spoken.write.mode("overwrite").parquet(f"{folder}/sources")
    manifest.enter(str(number), {"part": number})


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The sink's chunks: of every source those of the last replacement that spoke for it."""
    numbers = sorted(int(n) for n in Manifest(spark, path).entries())

    def parts(table: str) -> DataFrame:
        found = [spark.read.parquet(f"{path}/part-{n}/{table}").withColumn("_part", F.lit(n)) for n in numbers]
        return reduce(DataFrame.unionByName, found)

    if not numbers:
        raise ValueError(f"{path}: nothing has been stored yet")
    if len(numbers) == 1:
        return parts("chunks").drop("_part")
    last = parts("sources").groupBy("source_id").agg(F.max("_part").alias("_part"))
    return parts("chunks").join(last, ["source_id", "_part"], "left_semi").drop("_part")


def compact_chunks(spark: SparkSession, path: str) -> None:
    """Write what the sink holds as one replacement of every source it has ever spoken for."""
    numbers = sorted(int(n) for n in Manifest(spark, path).entries())
    spoken = reduce(DataFrame.union, [spark.read.parquet(f"{path}/part-{n}/sources") for n in numbers]).distinct()
    replace_chunks(read_chunks(spark, path), path, spoken)


def pending_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("ingestion_status") == "pending").orderBy("id")


def claimable(sources: DataFrame) -> DataFrame:
    """Every source with its claim result: ``in_progress`` ones are skipped, all others claimed."""
    busy = F.col("ingestion_status") == "in_progress"
    return sources.withColumn("claim", F.when(busy, "skipped").otherwise("claimed"))
