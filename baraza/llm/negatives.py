"""Hard negatives: for each anchor and each of its best positives the best rows of other labels inside a score window.

Scores are whole numbers: inner products of scaled components. The work is cut into cells, one for each part of the anchors
and strip of the rows, both of bounded size; a task holds the anchors of a cell and streams its rows past them. A tile of anchors
and rows is multiplied by Strassen's recursion on 64-bit integers, padded with zeros to even sides; its sums and products
may wrap, but a score below 2 ** 62 comes out exactly. Each cell keeps one heap per anchor (positives) or per anchor and
positive (negatives in the window); heaps of several cells merge by taking the best of their union.

* Rows with a null id, label or vector, or a null or non-finite component, take no part; nor does a row of squared length 2 ** 60
  or more after scaling, whose scores might not fit a long.
* A repeated row counts once; of unlike rows with one id the one with the smallest (label, vector) counts.
* Ties go to the smaller id. An anchor without positives, or a positive without negatives, gives no rows; an empty table none.
* A vector shorter than another counts as continued by zeros. Further columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baraza.llm.common import in_batches, stored

LEAF = 32  # sides up to this are multiplied plainly
TILE_ANCHORS, TILE_ROWS = 256, 1024
PART_VALUES = 1 << 21  # components of a cell's anchors
STRIP_ROWS = (4096, 262_144)
LOWEST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` for int64 matrices with seven products of half the sides, modulo 2 ** 64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def score_window(score):
    """The negative scores that ``50 * p <= 100 * n <= 95 * p`` allows for the positive score ``p``; nothing overflows."""
    return -(-score // 2), score + (-score // 20)


class Heaps:
    """The best ``size`` entries of each heap by score, then id."""

    def __init__(self, count: int, size: int):
        self.size = size
        self.heap, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.bar = np.full(count, LOWEST)  # what an entry must reach

    def push(self, heap: np.ndarray, score: np.ndarray, number: np.ndarray) -> None:
        if not len(heap):
            return
        heap, score, number = (np.concatenate(x) for x in ((self.heap, heap), (self.score, score), (self.id, number)))
        order = np.lexsort((number, -score, heap))
        heap, score, number = heap[order], score[order], number[order]
        lead = np.searchsorted(heap, heap)
        keep = np.arange(len(heap)) - lead < self.size
        self.heap, self.score, self.id = heap[keep], score[keep], number[keep]
        full = np.flatnonzero(np.bincount(self.heap, minlength=len(self.bar)) == self.size)
        last = np.searchsorted(self.heap, full, "right") - 1
        self.bar[full] = self.score[last]

    def offer(self, tile: np.ndarray, allowed: np.ndarray, heaps: np.ndarray, ids: np.ndarray) -> None:
        """Entries of ``tile`` where ``allowed``; row ``i`` goes to heap ``heaps[i]``, column ``j`` is row ``ids[j]``."""
        allowed = allowed & (tile >= self.bar[heaps][:, None])
        if np.count_nonzero(allowed) > 4 * self.size * len(heaps) and tile.shape[1] > self.size:
            held = np.where(allowed, tile, LOWEST)
            allowed &= tile >= np.partition(held, -self.size, axis=1)[:, -self.size, None]
        at, column = np.nonzero(allowed)
        self.push(heaps[at], tile[at, column], ids[column])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.zeros((len(column), width), np.int64)
    rows[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return rows


class _Positives:
    """One heap per anchor: other rows of its label."""

    names = ["anchor_id", "positive_id", "positive_score"]

    def __init__(self, anchors: pa.Table, width: int, keep: int):
        order = np.argsort(anchors.column("label").to_numpy(), kind="stable")
        self.ids, self.labels = anchors.column("vec_id").to_numpy()[order], anchors.column("label").to_numpy()[order]
        self.vectors = _matrix(anchors.column("vector").combine_chunks(), width)[order]
        self.heaps = Heaps(len(order), keep)

    def rows(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        # rows come by label, so few anchors share a label with a tile of them
        first, last = np.searchsorted(self.labels, labels.min()), np.searchsorted(self.labels, labels.max(), "right")
        for a in range(first, last, TILE_ANCHORS):
            b = min(a + TILE_ANCHORS, last)
            tile = strassen(self.vectors[a:b], vectors.T)
            self.heaps.offer(tile, (self.labels[a:b, None] == labels) & (self.ids[a:b, None] != ids), np.arange(a, b), ids)

    def found(self) -> pa.RecordBatch:
        h = self.heaps
        return pa.RecordBatch.from_arrays([pa.array(self.ids[h.heap]), pa.array(h.id), pa.array(h.score)], names=self.names)


class _Negatives:
    """One heap per anchor and positive: rows of other labels in the positive's window."""

    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def __init__(self, anchors: pa.Table, width: int, keep: int):
        self.ids, self.labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        self.vectors = _matrix(anchors.column("vector").combine_chunks(), width)
        listed = anchors.column("positives").combine_chunks()
        self.at = np.repeat(np.arange(len(self.ids)), np.diff(listed.offsets.to_numpy()))  # the anchor of each positive
        pairs = listed.flatten()
        self.positive, self.score = pairs.field("id").to_numpy(), pairs.field("score").to_numpy()
        self.low, self.high = score_window(self.score)
        self.first = np.searchsorted(self.at, np.arange(len(self.ids) + 1))
        self.heaps = Heaps(len(self.at), keep)

    def rows(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        for a in range(0, len(self.ids), TILE_ANCHORS):
            b = min(a + TILE_ANCHORS, len(self.ids))
            tile = strassen(self.vectors[a:b], vectors.T)
            other = self.labels[a:b, None] != labels
            counts = np.diff(self.first[a:b + 1])
            for nth in range(counts.max(initial=0)):
                has = np.flatnonzero(counts > nth)
                heap = self.first[a:b][has] + nth
                part = tile[has]
                self.heaps.offer(part, other[has] & (part >= self.low[heap][:, None]) & (part <= self.high[heap][:, None]), heap, ids)

    def found(self) -> pa.RecordBatch:
        h = self.heaps
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.at[h.heap]]), pa.array(self.positive[h.heap]), pa.array(self.score[h.heap]),
                                           pa.array(h.id), pa.array(h.score)], names=self.names)


def _in_cells(kind, width: int, keep: int):
    """A cell's anchors come first, then its rows by label; only the anchors are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, work = None, [], None
        for batch in batches:
            cells, sides = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            edges = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1).tolist(), len(cells)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if cells[a] != cell:
                    if work:
                        yield work.found()
                    cell, held, work = cells[a], [], None
                part = batch.slice(a, b - a)
                if sides[a] == 0:
                    held.append(part)
                    continue
                if held and work is None:
                    work, held = kind(pa.Table.from_batches(held), width, keep), []
                if work:
                    for c in range(0, len(part), TILE_ROWS):
                        rows = part.slice(c, TILE_ROWS)
                        work.rows(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("vector"), width))
        if work:
            yield work.found()
    return run


def scaled_rows(rows: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, vector``: the rows that take part, their components scaled and floored."""
    # null components make the test null or false; so do NaN and the infinities
    fit = F.forall("embedding", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    found = (rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fit)
             .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vector")))
    found = found.where(square < float(1 << 60)).withColumn("vector", F.col("vector").cast("array<int>"))
    return found.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")


def _scan(anchors: DataFrame, rows: DataFrame, parts: int, strips: int, run, schema: str) -> DataFrame:
    """Every anchor meets every row once: anchors go to each strip of their part, rows to each part of their strip."""
    def dealt(df: DataFrame, own: str, count: int, other: str, others: int, side: int) -> DataFrame:
        at = df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(count))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return at.select((F.col("part") * strips + F.col("strip")).cast("int").alias("cell"), F.lit(side).alias("side"), *df.columns)

    both = dealt(anchors, "part", parts, "strip", strips, 0).unionByName(dealt(rows, "strip", strips, "part", parts, 1), allowMissingColumns=True)
    placed = both.repartitionById(parts * strips, "cell").sortWithinPartitions("cell", "side", "label")
    return in_batches(placed, run, schema)


def _best(df: DataFrame, keys: list[str], score: str, number: str, keep: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(number))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(rows: DataFrame, is_anchor: Column, *, scale: int = 256, positives: int = 5, negatives: int = 3,
                   part_values: int = PART_VALUES, strip_rows: tuple[int, int] = STRIP_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` over ``rows`` of ``vec_id, embedding, label``.

    An anchor is a row with ``is_anchor``. Strips hold between the two numbers of ``strip_rows``, a sixty-fourth of the rows if
    that lies between them; parts of anchors hold about ``part_values`` components.
    """
    table = stored(scaled_rows(rows, scale), "vectors")
    anchors = table.where(is_anchor)
    n, width = table.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    parts = max(1, -(-anchors.count() * max(width, 1) // part_values))
    strips = max(1, -(-n // min(max(n // 64, strip_rows[0]), strip_rows[1])))

    near = _scan(anchors, table, parts, strips, _in_cells(_Positives, width, positives), "anchor_id long, positive_id long, positive_score long")
    chosen = stored(_best(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    listed = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    hard = _scan(anchors.join(listed, "vec_id"), table, parts, strips, _in_cells(_Negatives, width, negatives),
                 "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return _best(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
