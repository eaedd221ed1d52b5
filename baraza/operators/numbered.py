"""Running numbers and sums inside keys without a task that holds a key.

Rows are dealt into ranges of (key, order), written once with the number of their range, and counted per range and key: what a
later range needs of a key is one small row of each earlier range. So a key of any size and order values of any kind - sparse,
textual, repeated - are spread over as many tasks as they have ranges. Unlike blocks that are cut from the order value
(``operators.ordered``), ranges follow the number of rows.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baraza.operators.grouped import join_same
from baraza.session import run_folder

RANGE = "_range"


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` as a stored table whose column ``_range`` grows along (keys, order); equal rows share a range."""
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    placed = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    folder = run_folder(df.sparkSession, "ranges")
    # written before it is read twice: two runs of one plan could cut the ranges elsewhere
    placed.withColumn(RANGE, F.spark_partition_id()).write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], *, ranges: int | None = None,
                keep_range: bool = False) -> DataFrame:
    """Add, per entry of ``sums``, the sum over the key's rows before this one in ``order`` (0 for the first).

    A null key is a key of its own; a null order value comes first. Rows equal in ``order`` come in some fixed sequence. Ranges are cut
    from a sample of ``df``, so one that is costly to make is better stored before.
    """
    placed = in_ranges(df.withColumns({f"_of_{n}": c for n, c in sums.items()}), keys, order, ranges)
    totals = placed.groupBy(RANGE, *keys).agg(*[F.sum(f"_of_{n}").alias(f"_all_{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(RANGE, *keys, *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_from_{n}") for n in sums])
    within = Window.partitionBy(RANGE, *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({n: F.coalesce(F.sum(f"_of_{n}").over(within), F.lit(0)) for n in sums})
    summed = [(F.col(n) + F.col(f"_from_{n}")).alias(n) for n in sums]
    return join_same(local, carried, [RANGE, *keys]).select(*df.columns, *([RANGE] if keep_range else []), *summed)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, *, ranges: int | None = None, keep_range: bool = False) -> DataFrame:
    """Add the row's number inside its key, from 0."""
    return prefix_sums(df, keys, order, {out: F.lit(1).cast("long")}, ranges=ranges, keep_range=keep_range)
