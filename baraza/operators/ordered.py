"""Ordered operators that stay balanced when one key holds a large share of all rows.

A window partitioned by the key alone would sort a hot key in a single task. Here the rows of a key
are cut into blocks of consecutive values of an integer order column that is unique within the key, so a
block holds at most ``block`` rows. Window functions run per (key, block); one summary row per block
carries what later blocks need, and a second window over those few summary rows joins it back. The
summary is smaller than the input by up to the block size. The block is a plain function of the row, so
a recomputed task yields the same blocks. Where order values are sparse such blocks hold few rows each; rows that were dealt
into ranges (``operators.numbered``) use the range as their block instead.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def _blocked(df: DataFrame, order: str, block: int | str) -> DataFrame:
    """``block`` is a number of consecutive order values, or a column that grows with them (``numbered.RANGE``)."""
    return df.withColumn("_block", F.col(block) if isinstance(block, str) else F.expr(f"`{order}` div {block}"))


def _within(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys, "_block").orderBy(order)


def _across(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_block")


_BEFORE = (Window.unboundedPreceding, -1)


def _shuffled_once(rows: DataFrame, keys: Sequence[str], once: bool) -> DataFrame:
    """With ``once`` both uses of ``rows`` read one shuffle, so values that are costly to make are made once.

    Meant for narrow rows: the summary then reads whole rows instead of the columns it needs.
    """
    return rows.repartition(*keys, "_block") if once else rows


def forward_fill(df: DataFrame, keys: Sequence[str], order: str, fills: dict[str, Column], *,
                 inclusive: bool = True, block: int | str = BLOCK, once: bool = False) -> DataFrame:
    """Add, per entry of ``fills``, the latest non-null value at or before (``inclusive``) the row.

    With ``inclusive=False`` this is a backward as-of lookup inside the key.
    """
    raw = {name: f"_raw_{i}" for i, name in enumerate(fills)}
    rows = _shuffled_once(_blocked(df, order, block).withColumns({raw[n]: c for n, c in fills.items()}), keys, once)
    last_in_block = rows.groupBy(*keys, "_block").agg(*[
        F.max_by(F.struct(F.col(r).alias("v")), F.when(F.col(r).isNotNull(), F.col(order))).alias(r)
        for r in raw.values()])
    carried = last_in_block.select(*keys, "_block", *[
        F.last(r, ignorenulls=True).over(_across(keys).rowsBetween(*_BEFORE))["v"].alias(f"_carry{r}")
        for r in raw.values()])
    frame = _within(keys, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = rows.withColumns({n: F.last(r, ignorenulls=True).over(frame) for n, r in raw.items()})
    joined = local.join(carried, [*keys, "_block"], "left")
    filled = {n: F.coalesce(F.col(n), F.col(f"_carry{r}")) for n, r in raw.items()}
    return joined.withColumns(filled).select(*df.columns, *fills)


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, *,
                inclusive: bool = True, block: int | str = BLOCK, once: bool = False) -> DataFrame:
    """Add the sum of ``value`` over the key's rows up to (``inclusive``) this row."""
    rows = _shuffled_once(_blocked(df, order, block).withColumn("_value", value), keys, once)
    totals = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    carried = totals.select(*keys, "_block",
                            F.sum("_total").over(_across(keys).rowsBetween(*_BEFORE)).alias("_carry"))
    frame = _within(keys, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = rows.withColumn("_local", F.sum("_value").over(frame))
    total = F.coalesce(F.col("_local"), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
    return local.join(carried, [*keys, "_block"], "left").withColumn(out, total).select(*df.columns, out)


def previous_row(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, *,
                 block: int | str = BLOCK) -> DataFrame:
    """Add ``value`` of the key's directly preceding row (null for the first)."""
    rows = _blocked(df, order, block).withColumn("_value", F.struct(value.alias("v")))
    last_row = rows.groupBy(*keys, "_block").agg(F.max_by("_value", order).alias("_last"))
    carried = last_row.select(*keys, "_block", F.lag("_last").over(_across(keys)).alias("_carry"))
    local = rows.withColumn("_local", F.lag("_value").over(_within(keys, order)))
    return (local.join(carried, [*keys, "_block"], "left")
            .withColumn(out, F.coalesce("_local", "_carry")["v"]).select(*df.columns, out))


def previous_rows(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, count: int, *,
                  block: int | str = BLOCK) -> DataFrame:
    """Add up to ``count`` values of the key's preceding rows, oldest first."""
    rows = _blocked(df, order, block).withColumn("_value", value)
    newest_first = Window.partitionBy(*keys, "_block").orderBy(F.desc(order))
    tails = (rows.select(*keys, "_block", order, "_value")
             .withColumn("_back", F.row_number().over(newest_first)).where(F.col("_back") <= count)
             .groupBy(*keys, "_block")
             .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_value").alias("v"))))
                  .alias("_tail")))
    # Every present block has at least one row, so ``count`` blocks back always suffice.
    carried = tails.select(*keys, "_block", F.flatten(
        F.collect_list(F.transform("_tail", lambda t: t["v"])).over(_across(keys).rowsBetween(-count, -1))
    ).alias("_carry"))
    local = rows.withColumn("_local", F.collect_list("_value").over(
        _within(keys, order).rowsBetween(-count, -1)))
    merged = F.concat(F.coalesce("_carry", F.array().cast(rows.select(F.array("_value")).schema[0].dataType)),
                      F.col("_local"))
    return (local.join(carried, [*keys, "_block"], "left").withColumn("_merged", merged)
            .withColumn(out, F.slice("_merged", F.greatest(F.size("_merged") - count + 1, F.lit(1)), F.lit(count)))
            .select(*df.columns, out))
