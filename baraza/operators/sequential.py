"""Decisions that depend on earlier decisions of the same key, as one pass over sorted rows.

Rows are placed by key, sorted inside the tasks and streamed through a small fold that keeps only its own
state, so no group is ever collected. A key above ``max_rows`` is cut where it is quiet (a pause that
empties the fold's state makes the parts independent), and a part that is still too long is cut into
consecutive segments that are run in rounds - all keys at once per round - handing on only the fold's state.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baraza.session import shared_folder

MAX_ROWS = 5_000_000


class Fold:
    """One sequential rule. ``inputs`` name the columns given to ``step``; ``outputs`` the columns it returns."""

    inputs: list[str]
    outputs: list[tuple[str, T.DataType]]
    state_type: T.DataType

    def start(self, carried):
        raise NotImplementedError

    def step(self, state, *values) -> tuple:
        raise NotImplementedError

    def carry(self, state):
        raise NotImplementedError


def _stream(fold: Fold, columns: list[str], group: list[str], carry_column: str | None, keep_state: bool, schema):
    places = [columns.index(c) for c in fold.inputs]
    group_places = [columns.index(g) for g in group]
    carry_place = columns.index(carry_column) if carry_column else None
    width = len(fold.outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            groups = list(zip(*(batch.column(p).to_pylist() for p in group_places)))
            values = zip(*(batch.column(p).to_pylist() for p in places))
            carried = batch.column(carry_place).to_pylist() if carry_place is not None else None
            results = [[] for _ in range(width + keep_state)]
            for i, row in enumerate(values):
                if groups[i] != current:
                    current = groups[i]
                    state = fold.start(carried[i] if carried else None)
                for column, value in zip(results, fold.step(state, *row)):
                    column.append(value)
                if keep_state:  # on a group's last row of the batch; a later batch's comes after it in order
                    results[width].append(fold.carry(state) if i + 1 == len(groups) or groups[i + 1] != current else None)
            arrays = [batch.column(j) for j, c in enumerate(columns) if c != carry_column]
            names = [c for c in columns if c != carry_column]
            new = schema.fields[len(names):]
            arrays += [pa.array(r, type=_arrow(f.dataType)) for r, f in zip(results, new)]
            yield pa.RecordBatch.from_arrays(arrays, names=names + [f.name for f in new])
    return run


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[kind.simpleString()]


def one_pass(df, fold, group, order, carry_column=None, keep_state=False):
    """``fold`` over each group's rows in ``order``; a group is one task's work."""
    columns = df.columns
    fields = [f for f in df.schema.fields if f.name != carry_column]
    fields += [T.StructField(n, t) for n, t in fold.outputs]
    if keep_state:
        fields.append(T.StructField("_state", fold.state_type))
    schema = T.StructType(fields)
    placed = df.repartition(*group).sortWithinPartitions(*group, *order)
    return placed.mapInArrow(_stream(fold, columns, group, carry_column, keep_state, schema), schema)


def largest_key(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def sequential_scan(df: DataFrame, keys: list[str], time_us: str, order: list[str], fold: Fold, *,
                    quiet_us: int | None = None, segment_us: int = 3_600_000_000,
                    max_rows: int = MAX_ROWS, largest: int | None = None) -> DataFrame:
    """Run ``fold`` over each key's rows in ``order`` and add its output columns.

    ``time_us`` is the event time in microseconds and leads ``order``. ``quiet_us``, if given, is a pause after
    which the fold's state is empty. ``largest``: the rows of the largest key, counted here if not given.
    """
    largest = largest_key(df, keys) if largest is None else largest
    if largest <= max_rows:
        return one_pass(df, fold, keys, order)

    slot = F.expr(f"`{time_us}` div {quiet_us or segment_us}")
    per_key = Window.partitionBy(*keys).orderBy("_slot")
    slots = df.withColumn("_slot", slot).groupBy(*keys, "_slot").agg(F.count("*").alias("_n"))
    # A slot of the pause's length without rows separates what lies before it from what lies after it.
    cut = (F.col("_slot") - F.lag("_slot").over(per_key) > 1).cast("int") if quiet_us else F.lit(0)
    slots = slots.withColumn("_part", F.sum(F.coalesce(cut, F.lit(0))).over(per_key))
    in_part = Window.partitionBy(*keys, "_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_level", F.floor(F.coalesce(F.sum("_n").over(in_part), F.lit(0)) / max_rows))
    # Segment numbers without holes: every segment but the first finds its predecessor's state.
    slots = slots.withColumn("_segment", F.dense_rank().over(
        Window.partitionBy(*keys, "_part").orderBy("_level")) - 1).drop("_level")
    shared_folder(df.sparkSession)
    placed = (df.withColumn("_slot", slot).join(slots.drop("_n"), [*keys, "_slot"]).drop("_slot")).checkpoint()
    rounds = placed.agg(F.max("_segment")).first()[0] + 1
    group = [*keys, "_part"]
    if rounds == 1:
        return one_pass(placed.drop("_segment"), fold, group, order).drop("_part")

    done, states = None, None
    for number in range(rounds):
        rows = placed.where(F.col("_segment") == number).drop("_segment")
        if states is None:
            rows = rows.withColumn("_carried", F.lit(None).cast(fold.state_type))
        else:
            rows = rows.join(states.withColumnRenamed("_state", "_carried"), group, "left")
        result = one_pass(rows, fold, group, order, "_carried", keep_state=True).checkpoint()
        ends = result.where(F.col("_state").isNotNull())
        states = ends.groupBy(*group).agg(F.max_by("_state", F.struct(*order)).alias("_state"))
        result = result.drop("_state", "_part")
        done = result if done is None else done.unionByName(result)
    return done
