"""Column functions for words and phrases."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_words(text: Column, between: str) -> Column:
    """The words of ``text``: what stands between the runs of ``between``. A null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), between)
    # only the first and the last part can be empty
    lead = (parts[0] == "").cast("int")
    tail = (F.element_at(parts, -1) == "").cast("int")
    return F.slice(parts, lead + 1, F.greatest(F.size(parts) - lead - tail, F.lit(0)))


def places(count: Column) -> Column:
    """``0 .. count - 1`` as an array, empty for 0."""
    return F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
