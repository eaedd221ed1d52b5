"""Grouped aggregates shared by the reports."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_filled_counts(df: DataFrame, column: str, domain: Sequence[str], out: str = "cnt") -> DataFrame:
    """Rows per value of ``column``, with a zero row for every domain value that does not occur."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counts = df.groupBy(column).agg(F.count("*").alias(out))
    return values.join(counts, column, "full").fillna(0, [out])


def counts_by_value(column: Column, domain: Sequence[str], prefix: str) -> list[Column]:
    """One conditional count per domain value: a zero-filled breakdown in a single aggregation."""
    return [F.count_if(column == v).alias(f"{prefix}{v}") for v in domain]


def earliest_per_group(df: DataFrame, keys: Sequence[str], order: str, latest_of: str, latest: str) -> DataFrame:
    """The row with the smallest ``order`` per group plus the group's maximum of ``latest_of``.

    One partial-then-final aggregation; a hot group collapses to one row per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"), F.max(latest_of).alias(latest))
    return grouped.select(*keys, "_row.*", latest)


def with_group_counts(df: DataFrame, keys: Sequence[str], counts: dict[str, Column]) -> DataFrame:
    """Add per-group aggregates to every row.

    Aggregating first and joining back (instead of a window over the group) keeps a hot group spread out:
    the aggregate is tiny, and a skewed join side is split by adaptive execution.
    """
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in counts.items()])
    return df.join(totals, list(keys))


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, null being equal to null; the keys come once."""
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    equal = reduce(and_, [left[k].eqNullSafe(renamed[f"_same_{k}"]) for k in keys])
    return left.join(renamed, equal, how).drop(*[f"_same_{k}" for k in keys])


def last_per_key(changes: DataFrame, keys: Sequence[str], sequence: str | None = None) -> DataFrame:
    """One change per key: the one with the largest ``sequence``, without a sequence the largest row."""
    row = F.struct(*changes.columns)
    order = F.struct(F.col(sequence), row) if sequence else row
    return changes.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.max_by(row, order).alias("_row")).select("_row.*")
