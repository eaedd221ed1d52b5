"""From page tables to traceable chunks."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baraza import fixed_values as fv
from baraza.functions.text import chunk_id, heading_county, strip, window_count, word_windows
from baraza.operators.numbered import RANGE, in_ranges
from baraza.operators.ordered import forward_fill, previous_row, running_sum
from baraza.session import run_folder
from baraza.sources.documents import readable_pages, text_layer


def page_sections(pages: DataFrame, counties=tuple(fv.COUNTIES), heading=None) -> DataFrame:
    """``(source, page, heading, section)`` of readable pages: own heading or null, and the latest heading so far.

    The texts are read once, for their headings; what is shuffled, ordered and filled is this narrow table.
    """
    found = heading if heading is not None else heading_county(F.col("text"), counties)
    marked = readable_pages(pages).select("source", "page", found.alias("heading"))
    return forward_fill(marked, ["source"], "page", {"section": F.col("heading")}, once=True)


def with_section(pages: DataFrame, counties=tuple(fv.COUNTIES), heading=None) -> DataFrame:
    """Add ``heading`` (own heading or null) and ``section`` (the latest heading so far) to readable pages.

    ``heading`` may be given as a ready column; by default it is found in the text. ``page`` is unique in its source.
    """
    return readable_pages(pages).join(page_sections(pages, counties, heading), ["source", "page"])


def county_page_numbers(pages: DataFrame, county: str, heading=None) -> DataFrame:
    """``(source, page)`` of one county's section; all readable pages of a source without any heading."""
    filled = page_sections(pages, heading=heading)
    headed = filled.where(F.col("heading").isNotNull()).select("source").distinct().withColumn("_headed", F.lit(True))
    # ``section`` is null only before the first heading, so most pages are decided without the source flag.
    flagged = filled.join(headed, "source", "left")
    keep = F.col("_headed").isNull() | (F.lower("section") == county.lower())
    return flagged.where(keep).select("source", "page")


def county_pages(pages: DataFrame, county: str, heading=None) -> DataFrame:
    """The pages that ``county_page_numbers`` names, with their texts."""
    numbers = county_page_numbers(pages, county, heading)
    return readable_pages(pages).join(numbers, ["source", "page"], "left_semi").select("source", "page", "text")


def section_changes(pages: DataFrame, heading=None) -> DataFrame:
    """``(source, page, section, previous_section)`` where a source's section changes."""
    filled = page_sections(pages, heading=heading)
    lagged = previous_row(filled, ["source"], "page", F.col("section"), "previous_section")
    changed = ~F.col("section").eqNullSafe(F.col("previous_section"))
    return lagged.where(changed).select("source", "page", "section", "previous_section")


def chunk_pages(pages: DataFrame, size: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """``(chunk_id, source, page, chunk_no, text)``: windows never cross pages or numbered sections. No shuffle."""
    kept = [c for c in pages.columns if c != "text"]
    exploded = pages.select(*kept, F.posexplode(word_windows(F.col("text"), size, overlap)).alias("chunk_no", "text"))
    return exploded.select(chunk_id(F.col("source"), F.col("page"), F.col("chunk_no")).alias("chunk_id"),
                           *kept, "chunk_no", "text")


def chunk_pages_numbered(pages: DataFrame, size: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """``chunk_pages`` plus ``chunk_index``, the chunk's number within its source.

    The number of chunks before a page is a running sum of page counts, for which no chunk has to be cut. It runs over narrow
    rows and is joined to the pages, whose texts stay where they are if Spark can broadcast it.
    """
    counts = pages.select("source", "page", window_count(F.col("text"), size, overlap).alias("_n"))
    before = running_sum(counts, ["source"], "page", F.col("_n"), "_before", inclusive=False, once=True).drop("_n")
    cut = chunk_pages(pages.join(before, ["source", "page"]), size, overlap)
    return cut.withColumn("chunk_index", F.col("_before") + F.col("chunk_no")).drop("_before")


def page_facts(pages: DataFrame, heading=None, size: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """``(source, page, n_chars, heading, n_chunks)``: all that choosing and numbering needs of a page, from one look at its text."""
    found = heading if heading is not None else heading_county(F.col("text"))
    trimmed = pages.withColumn("text", strip(F.col("text")))
    readable = F.length("text") >= fv.MIN_PAGE_CHARS
    return trimmed.select("source", "page", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), F.when(readable, found).alias("heading"),
                          F.when(readable, window_count(F.col("text"), size, overlap)).otherwise(0).cast("long").alias("n_chunks"))


def chosen_pages(facts: DataFrame, county: str, *, first_pages: int = fv.TEXT_LAYER_PAGES,
                 layer_chars: int = fv.MIN_PAGE_CHARS) -> tuple[DataFrame, DataFrame]:
    """``(chosen, layers)``: the pages of one county's section with the number of chunks before each (``source, page, before``), and
    for each source whether one of its first pages holds text (``source, has_text``).

    ``facts`` is a stored table of ``page_facts``. The first pages are told by their number in the source, not by what they are
    called; a source of any size is spread over ranges.
    """
    placed = in_ranges(facts, ["source"], ["page"])
    layers = text_layer(running_sum(placed, ["source"], "page", F.lit(1), "number", inclusive=False, block=RANGE), first_pages, layer_chars)
    readable = placed.where(F.col("n_chars") >= fv.MIN_PAGE_CHARS)
    filled = forward_fill(readable, ["source"], "page", {"section": F.col("heading")}, block=RANGE)
    about = layers.join(readable.groupBy("source").agg(F.max("heading").isNotNull().alias("headed")), "source")
    kept = (filled.join(about.where("has_text"), "source")
            .where(~F.col("headed") | (F.lower("section") == county.lower())).select(*placed.columns))
    chosen = running_sum(kept, ["source"], "page", F.col("n_chunks"), "before", inclusive=False, block=RANGE)
    return chosen.select("source", "page", "before"), layers


def described_chunks(cut: DataFrame, sources: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``cut`` (``chunk_id, source, page, chunk_index, text``) with what its source says about it, as rows of the chunk table."""
    known = sources.select(F.col("id").alias("source_id"), F.col("title").alias("source"), "government_arm", "county")
    chunks = cut.join(known, "source").select(
        "source_id", "government_arm", "county", F.col("text").alias("chunk_text"),
        F.col("page").cast("int").alias("page_number"), F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_id")
    return embed(chunks) if embed is not None else chunks


def ingest_outcomes(chosen: DataFrame, layers: DataFrame, sources: DataFrame, county: str) -> DataFrame:
    """``(source_id, status, error, page_count)`` for every source that has pages."""
    counts = chosen.groupBy("source").agg(F.count("*").alias("page_count"))
    known = sources.select(F.col("id").alias("source_id"), F.col("title").alias("source"))
    found = known.join(layers, "source").join(counts, "source", "left")
    error = (F.when(~F.col("has_text"), "no text layer: scanned pages need OCR")
             .when(F.col("page_count").isNull(), F.concat(F.lit("no pages found for county "), F.lit(county))))
    return found.select("source_id", F.when(error.isNull(), "completed").otherwise("failed").alias("status"),
                        F.left(error, F.lit(fv.MAX_ERROR_CHARS)).alias("error"), F.coalesce("page_count", F.lit(0)).alias("page_count"))


def build_chunks(pages: DataFrame, sources: DataFrame, county: str, *,
                 embed: Callable[[DataFrame], DataFrame] | None = None,
                 size: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP,
                 first_pages: int = fv.TEXT_LAYER_PAGES, layer_chars: int = fv.MIN_PAGE_CHARS, heading=None) -> tuple[DataFrame, DataFrame]:
    """The whole ingestion: ``(chunks, outcomes)`` for every source that has pages.

    ``pages`` has ``source, page, text``; ``sources`` has ``id, title, government_arm, county`` and pages refer to
    ``title``. Outcomes name the sources without a text layer or without pages for the county. Texts are read twice: once for the
    narrow table that decides, and once to cut the chosen pages, behind a semi-join with their numbers.
    """
    spark = pages.sparkSession
    folder = run_folder(spark, "corpus")
    page_facts(pages, heading, size, overlap).write.parquet(f"{folder}/facts")
    chosen, layers = chosen_pages(spark.read.parquet(f"{folder}/facts"), county, first_pages=first_pages, layer_chars=layer_chars)
    chosen.write.parquet(f"{folder}/chosen")
    chosen = spark.read.parquet(f"{folder}/chosen")
    cut = chunk_pages(readable_pages(pages).select("source", "page", "text").join(chosen, ["source", "page"]), size, overlap)
    cut = cut.withColumn("chunk_index", F.col("before") + F.col("chunk_no"))
    return described_chunks(cut, sources, embed), ingest_outcomes(chosen, layers, sources, county)
