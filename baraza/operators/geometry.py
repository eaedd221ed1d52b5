"""Text blocks and ruled tables on a page: drop covered blocks, join the rest in reading order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baraza.functions.text import strip

COVERED = 0.5


def table_text(markdown):
    """A rendered table with wrapped cells on one line."""
    return strip(F.regexp_replace(markdown, "<br/?>", " "))


def outside_tables(blocks: DataFrame, tables: DataFrame, covered: float = COVERED) -> DataFrame:
    """Blocks that no table of their page covers by more than ``covered`` of the block's area.

    The page is the equality key of the join; overlap is a condition on top of it.
    """
    b, t = blocks.alias("b"), tables.alias("t")
    width = F.least("b.x1", "t.x1") - F.greatest("b.x0", "t.x0")
    height = F.least("b.y1", "t.y1") - F.greatest("b.y0", "t.y0")
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    inside = ((F.col("b.source") == F.col("t.source")) & (F.col("b.page") == F.col("t.page"))
              & (width > 0) & (height > 0) & (area > 0) & (width * height > covered * area))
    return b.join(t, inside, "left_anti")


def reading_order(items: DataFrame) -> DataFrame:
    """``(source, page, text)``: a page's pieces top to bottom, left to right, a blank line between them."""
    pieces = F.array_sort(F.collect_list(F.struct("y0", "x0", "seq", "text")))
    return items.groupBy("source", "page").agg(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "\n\n").alias("text"))


def page_text(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Page texts from positioned ``blocks`` and ``tables`` (``source, page, x0, y0, x1, y1, seq, text``)."""
    rendered = tables.withColumn("text", table_text(F.col("text"))).where(F.col("text") != "")
    kept = outside_tables(blocks, rendered).withColumn("text", strip(F.col("text"))).where(F.col("text") != "")
    columns = ["source", "page", "x0", "y0", "seq", "text"]
    # Blocks come before tables at equal positions.
    last = F.lit(1 << 40).cast("long")
    return reading_order(kept.select(*columns).unionByName(rendered.withColumn("seq", last + F.col("seq")).select(*columns)))
