"""Exact nearest vectors: every query against every vector, keeping only the best ``k``.

A counted, small query table is broadcast as one matrix and the vectors stream past it. A larger one is taken in parts of that size,
one pass over the vectors for each. Inside a task blocks of queries meet blocks of vectors: a product in single precision finds the few
pairs that may reach a query's best so far, and these are scored in double precision.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baraza.operators.blocked import CELLS, FIRST_ROWS, GROUPS, BestPerQuery, in_passes, scan
from baraza.operators.topk import top_k

BROADCAST_BYTES = 64 << 20
SCOPE_FILTER = 1000  # scopes named in a scan's filter
HELD_BYTES = 96  # what a task holds for one of the ``k`` best rows of a query
ASKED = 512  # queries scored at once


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of unit rows."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = array.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    lengths = {n for n in pc.list_value_length(array).unique().to_pylist()}
    if len(lengths) > 1:
        raise ValueError(f"vectors of unlike lengths: {sorted(lengths)[:5]}")
    rows = values.reshape(len(array), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class _Block:
    """Up to ``ASKED`` queries of one scope (null: they see every vector) and what they have found."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, skip_same_id: bool):
        self.matrix, self.single, self.best = matrix, matrix.astype("float32"), BestPerQuery(ids, k)
        # rounding of single precision, of the unit vectors and of their products
        self.slack = 2e-7 * (matrix.shape[1] + 4)
        self.order = np.argsort(ids, kind="stable") if skip_same_id else None
        self.begun = False

    def offer(self, held: np.ndarray, single: np.ndarray, ids: np.ndarray) -> None:
        step = max(1, CELLS // len(self.matrix))
        if not self.begun and len(ids):
            self._begin(single[:FIRST_ROWS], ids[:FIRST_ROWS], step)
        for start in range(0, len(ids), step):
            here = slice(start, start + step)
            vectors, own = held[here], ids[here]
            self.best.screen(self._without_same(self.single @ single[here].T, own), self.slack, own,
                             lambda r, c: np.einsum("ij,ij->i", self.matrix[r], vectors[c]),
                             lambda: self._without_same(self.matrix @ vectors.T, own))

    def _begin(self, single: np.ndarray, ids: np.ndarray, step: int) -> None:
        self.begun, size, maxima = True, max(1, len(ids) // GROUPS), []
        step = max(step - step % size, size)
        for start in range(0, len(ids), step):
            here = slice(start, start + step)
            scores = self._without_same(self.single @ single[here].T, ids[here])
            maxima.append(np.fmax.reduceat(scores, np.arange(0, scores.shape[1], size), axis=1))
        self.best.raise_floor(np.hstack(maxima), self.slack)

    def _without_same(self, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if self.order is not None:
            own = self.best.query_ids[self.order]
            first, behind = np.searchsorted(own, ids, "left"), np.searchsorted(own, ids, "right")
            column = np.repeat(np.arange(len(ids)), behind - first)
            inside = np.arange(len(column)) - np.repeat(np.cumsum(behind - first) - (behind - first), behind - first)
            scores[self.order[first[column] + inside], column] = np.nan
        return scores


def _blocks(asked: dict, k: int, skip_same_id: bool) -> dict:
    """The queries' blocks by scope; without scopes all see every vector, as those of a null scope do."""
    scopes, blocks = asked["scopes"], {}
    places = {None: np.arange(len(asked["ids"]))}
    if scopes is not None:
        codes, names = pd.factorize(scopes)
        order, sorted_codes = np.argsort(codes, kind="stable"), np.sort(codes)
        places = {name: order[slice(*np.searchsorted(sorted_codes, [c, c + 1]))] for c, name in [(-1, None), *enumerate(names)]}
    for name, who in places.items():
        blocks[name] = [_Block(asked["ids"][w], asked["matrix"][w], k, skip_same_id)
                        for w in (who[i:i + ASKED] for i in range(0, len(who), ASKED))]
    return blocks


def nearest(queries: DataFrame, vectors: DataFrame, k: int, *, scope: bool = False, skip_same_id: bool = False,
            broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(query_id, id, similarity, rank)``: the ``k`` most similar vectors per query.

    ``queries`` has ``query_id, vector[, scope]`` and ``vectors`` has ``id, vector[, scope]``. With
    ``scope`` a query sees only vectors of its own scope (a null query scope sees all): scopes that no query sees are left to the scan's
    filter, and a task multiplies only queries and vectors that share one.
    Similarity is cosine, rounded to 4 decimals; ties go to the smaller id. A null vector is never found and finds
    nothing; vectors of unlike lengths are an error that names them.
    """
    extra = ["scope"] if scope else []
    queries = queries.where(F.col("vector").isNotNull()).select("query_id", "vector", *extra)
    vectors = vectors.where(F.col("vector").isNotNull()).select("id", "vector", *extra)

    def start(asked: dict, k: int):
        blocks = _blocks(asked, k, skip_same_id)

        def offer(part: pa.RecordBatch) -> None:
            ids = part.column("id").to_numpy(zero_copy_only=False)
            held = _matrix(part.column("vector"))
            single = held.astype("float32")
            for block in blocks[None]:
                block.offer(held, single, ids)
            if scope:
                coded = pc.dictionary_encode(part.column("scope"))
                codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                for code, name in enumerate(coded.dictionary.to_pylist()):
                    if name in blocks and name is not None:
                        rows = np.flatnonzero(codes == code)
                        for block in blocks[name]:
                            block.offer(held[rows], single[rows], ids[rows])

        return [block.best for own in blocks.values() for block in own], offer

    def run(part: DataFrame) -> DataFrame:
        table = part.toArrow()  # counted: about ``broadcast_bytes`` at most
        if not table.num_rows:
            return vectors.sparkSession.createDataFrame([], "query_id long, id long, similarity double")
        scopes = table.column("scope").to_pandas().to_numpy() if scope else None
        asked = {"ids": table.column("query_id").to_numpy(), "matrix": _matrix(table.column("vector")), "scopes": scopes}
        seen = vectors
        if scope and not pd.isna(scopes).any():
            wanted = sorted(set(scopes))
            seen = vectors.where(F.col("scope").isin(wanted)) if len(wanted) <= SCOPE_FILTER else vectors
        return scan(seen, start, vectors.sparkSession.sparkContext.broadcast(asked), k, "similarity")

    size = queries.agg(F.sum(16 + 8 * F.size("vector") + HELD_BYTES * k).alias("bytes"),
                       *([F.sum(F.length(F.coalesce(F.col("scope").cast("string"), F.lit("")))).alias("scopes")] if scope else [])).first()
    total = (size["bytes"] or 0) + ((size["scopes"] or 0) if scope else 0)
    found = run(queries) if total <= broadcast_bytes else in_passes(queries, -(-total // max(broadcast_bytes, 1)), run, "nearest")
    return top_k(found, ["query_id"], [F.desc("similarity"), F.asc("id")], k)
