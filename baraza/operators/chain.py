"""Chains of rows inside keys: from the key's first row on, each chain row is the first one a fixed pause after the last.

Such a rule - one event per pause, blocked ones leave no trace - looks sequential, but what follows a chain row depends on that row
alone. So every row gets a pointer to its successor (one ordered look-up over all rows), and the chain comes from doubling the
pointers: round ``r`` adds the rows that lie ``2 ** r`` steps behind the chain's rows so far. A key with ``n`` chain rows takes
``log2(n)`` joins over rows that are spread by their number, and no task holds a key.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baraza.operators.grouped import join_same
from baraza.operators.numbered import RANGE, in_ranges, numbered
from baraza.session import run_folder


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def successors(rows: DataFrame, keys: Sequence[str], time: str, pause: int, ranges: int | None = None) -> DataFrame:
    """``(*keys, number, next)``: for each row the number of the key's first row at least ``pause`` later, null if there is none.

    ``rows`` holds ``keys``, ``time`` (a whole number) and ``number``, which counts a key's rows in the order of ``time``.
    """
    events = rows.select(*keys, F.col(time).alias("_at"), F.lit(1).alias("_side"), F.col("number").alias("_found"), F.lit(None).cast("long").alias("_asker"))
    asked = rows.select(*keys, (F.col(time) + pause).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_found"), F.col("number").alias("_asker"))
    # a question stands before the events of its time; the answer is the next event behind it
    placed = in_ranges(events.unionByName(asked), keys, ["_at", "_side"], ranges)
    first = placed.groupBy(RANGE, *keys).agg(F.min("_found").alias("_first"))
    later = Window.partitionBy(*keys).orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    carried = first.select(RANGE, *keys, F.min("_first").over(later).alias("_later"))
    behind = Window.partitionBy(RANGE, *keys).orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_next", F.min("_found").over(behind)).where("_side = 0")
    return join_same(local, carried, [RANGE, *keys]).select(*keys, F.col("_asker").alias("number"), F.coalesce("_next", "_later").alias("next"))


def paced(rows: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], pause: int, *, ranges: int | None = None) -> DataFrame:
    """Add ``in_chain`` and ``last_time``, the time of the latest chain row before a row outside the chain (null inside).

    A key's rows are taken by ``time`` (a whole number), then ``order``, which tells them apart. The rows are numbered, and all else
    works on their numbers and times.
    """
    folder = run_folder(rows.sparkSession, "chain")
    placed = _stored(numbered(rows, keys, [time, *order], "number", ranges=ranges, keep_range=True), folder, "rows")
    narrow = placed.select(*keys, time, "number")
    jump = _stored(successors(narrow, keys, time, pause, ranges), folder, "jump-0")
    chain = _stored(jump.where("number = 0").select(*keys, "number"), folder, "chain-0")
    step = 0
    while True:
        step += 1
        reached = join_same(chain, jump, [*keys, "number"]).where("next IS NOT NULL").select(*keys, F.col("next").alias("number"))
        reached = _stored(reached, folder, f"reached-{step}")
        if reached.isEmpty():
            break
        chain = _stored(chain.unionByName(reached), folder, f"chain-{step}")
        on = jump.select(*keys, F.col("number").alias("next"), F.col("next").alias("after"))
        # a row whose jump ends nowhere is never jumped from again
        jump = _stored(join_same(jump.where("next IS NOT NULL"), on, [*keys, "next"], "left").select(*keys, "number", F.col("after").alias("next")),
                       folder, f"jump-{step}")
    times = join_same(chain, narrow, [*keys, "number"]).select(*keys, "number", F.col(time).alias("_chain_time"))
    marked = _stored(join_same(placed, times, [*keys, "number"], "left"), folder, "marked")
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy(RANGE, *keys).agg(F.max("_chain_time").alias("_last")).select(
        RANGE, *keys, F.max("_last").over(earlier).alias("_before"))
    so_far = Window.partitionBy(RANGE, *keys).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    local = join_same(marked.withColumn("_local", F.max("_chain_time").over(so_far)), carried, [RANGE, *keys])
    inside = F.col("_chain_time").isNotNull()
    return local.select(*rows.columns, inside.alias("in_chain"), F.when(~inside, F.greatest("_local", "_before")).alias("last_time"))
