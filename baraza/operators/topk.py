"""Ranking within groups."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key in ``order``, with their 1-based rank.

    The rank filter lets Spark cut each task's rows to ``k`` per key before the shuffle
    (``WindowGroupLimit``), so a hot key ships at most ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def page_total(df: DataFrame) -> DataFrame:
    """The number of rows an ordered listing has in all, whatever page is shown."""
    return df.agg(F.count("*").alias("total"))


def page_of(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered listing."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)
