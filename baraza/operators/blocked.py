"""Best-``k`` selection inside tasks: score blocks of rows against broadcast queries, keep only the best.

A task streams its rows, scores them block-wise with NumPy and keeps at most ``k`` rows per query, so neither
the pairs nor the scores of a hot term, query or source are ever written or shuffled.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baraza.session import run_folder

SCALE = 10_000  # scores are kept to four decimals
CELLS = 1 << 18  # scores held at once in a task
RESCORED = 8192  # pairs scored in double precision at once
FIRST_ROWS, GROUPS = 2048, 64  # a task's first rows are scored twice: the best of their groups give a floor, then what reaches it is taken
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def scan(rows: DataFrame, start: Callable, shared, k: int, name: str) -> DataFrame:
    """Stream ``rows`` (``id`` first) past broadcast queries.

    ``start(shared, k)`` gives the ``BestPerQuery`` of each block of queries and a function that offers a batch of rows to them. Batches
    are of about ``BATCH_BYTES``, so what a worker holds depends on the queries alone.
    """
    conf = rows.sparkSession.conf
    if int(conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, offer = start(shared.value, k)
        for batch in batches:
            offer(batch)
        for best in blocks:
            yield from best.batches(name)

    return rows.mapInArrow(run, f"query_id long, id long, {name} double")


def in_passes(queries: DataFrame, count: int, run: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """The results of a query table too large to broadcast: it is cut into ``count`` parts, and ``run`` takes them one after the other.

    The rows searched are streamed once a pass and never copied or shuffled; a part's broadcast is all that is held at a time. Each
    pass is written before the next one starts.
    """
    spark = queries.sparkSession
    folder = run_folder(spark, label)
    queries.withColumn("_pass", F.pmod(F.xxhash64("query_id"), F.lit(count)).cast("int")).write.partitionBy("_pass").parquet(f"{folder}/queries")
    stored = spark.read.schema(T.StructType([*queries.schema.fields, T.StructField("_pass", T.IntegerType())])).parquet(f"{folder}/queries")
    for number in range(count):
        found = run(stored.where(F.col("_pass") == number).drop("_pass"))
        found.write.parquet(f"{folder}/found-{number}")
    return spark.read.schema(found.schema).parquet(*[f"{folder}/found-{n}" for n in range(count)])


class BestPerQuery:
    """The ``k`` best rows per query so far: rounded score descending, then id ascending.

    Once a query has ``k`` rows, the worst of them becomes a floor that turns later rows away: of a block of scores only the few pairs
    that reach their query's floor are looked at one by one.
    """

    def __init__(self, query_ids: np.ndarray, k: int, lowest: float = -np.inf):
        self.query_ids, self.k, self.lowest = query_ids, k, lowest
        self.floor = np.full(len(query_ids), -np.inf)
        self.last = np.full(len(query_ids), np.iinfo("int64").max)
        self.held, self.waiting = [], 0

    def raise_floor(self, maxima: np.ndarray, slack: float) -> None:
        """A first floor from the best scores, known up to ``slack``, that each query has in disjoint groups of rows ``(queries, groups)``.
        The rows must be offered yet.

        ``k`` groups with a score of at least ``b`` hold ``k`` such rows, so no lower row is among the best.
        """
        if maxima.shape[1] < self.k:
            return
        found = np.where(np.isnan(maxima), -np.inf, maxima).astype("float64")
        least = -np.partition(-found, self.k - 1, axis=1)[:, self.k - 1] - slack
        self.floor = np.maximum(self.floor, np.rint(least * SCALE) - 1)  # rows of that score still enter, whatever their ids

    def near(self, scores: np.ndarray, slack: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a score block ``(queries, rows)`` whose score, ``slack`` added, may enter; NaN never does."""
        least = np.maximum((self.floor - 0.5) / SCALE - slack, self.lowest).astype(scores.dtype)
        enough = scores >= least[:, None]
        if enough.flags.c_contiguous:
            return np.divmod(np.flatnonzero(enough), scores.shape[1])
        return np.divmod(np.flatnonzero(enough.T), len(scores))[::-1]

    def offer(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """Score block ``(queries, rows)`` of rows ``ids``."""
        if allowed is not None:
            scores = np.where(allowed, scores, np.nan)
        row, column = self.near(scores)
        if len(row) > 2 * self.k * len(scores) and self.k < len(ids):
            row, column = self._thinned(scores, ids)
        self.take(row, ids[column], scores[row, column])

    def screen(self, rough: np.ndarray, slack: float, ids: np.ndarray, pairs: Callable, whole: Callable) -> None:
        """A score block known up to ``slack``: ``pairs(who, columns)`` scores exactly what may enter, ``whole()`` all if that is much."""
        row, column = self.near(rough, slack)
        if len(row) * 64 > rough.size:
            return self.offer(whole(), ids)
        for start in range(0, len(row), RESCORED):
            r, c = row[start:start + RESCORED], column[start:start + RESCORED]
            self.take(r, ids[c], pairs(r, c))

    def _thinned(self, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` pairs of each query in a block."""
        n, never = len(ids), np.iinfo("int64").max
        by_id = np.empty(n, dtype="int64")
        by_id[np.argsort(ids, kind="stable")] = np.arange(n)
        # One integer carries both criteria, so a partial selection honours the tie rule exactly.
        eligible = scores >= self.lowest
        key = np.where(eligible, by_id[None, :] - np.rint(np.where(eligible, scores, 0.0) * SCALE).astype("int64") * n, never)
        chosen = np.argpartition(key, self.k - 1, axis=1)[:, :self.k]
        row, place = np.nonzero(np.take_along_axis(key, chosen, axis=1) != never)
        return row, chosen[row, place]

    def take(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Single pairs: the query at place ``who``, a row's id and their score."""
        rounded = np.rint(scores * SCALE)
        floor = self.floor[who]
        enters = (scores >= self.lowest) & ((rounded > floor) | ((rounded == floor) & (ids < self.last[who])))
        if not enters.any():
            return
        self.held.append((who[enters], ids[enters], rounded[enters]))
        self.waiting += int(enters.sum())
        if self.waiting > self.k * len(self.query_ids):
            self._settle()

    def settle(self) -> None:
        if self.held:
            self._settle()

    def _settle(self) -> None:
        who, ids, score = (np.concatenate(parts) for parts in zip(*self.held))
        order = np.lexsort((ids, -score, who))
        who, ids, score = who[order], ids[order], score[order]
        starts = np.searchsorted(who, np.arange(len(self.query_ids) + 1))
        best = np.arange(len(who)) - starts[who] < self.k
        full = np.flatnonzero(np.diff(starts) >= self.k)
        worst = starts[full] + self.k - 1
        self.floor[full], self.last[full] = score[worst], ids[worst]
        self.held, self.waiting = [(who[best], ids[best], score[best])], 0

    def frame(self, name: str) -> pd.DataFrame:
        self.settle()
        who, ids, score = self.held[0] if self.held else (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))
        return pd.DataFrame({"query_id": self.query_ids[who], "id": ids, name: score / SCALE})

    def batches(self, name: str) -> Iterator[pa.RecordBatch]:
        best = self.frame(name)
        if len(best):
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)
