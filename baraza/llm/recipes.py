"""Exact duplicates by content-defined chunk recipes.

Each text is cut where a rolling hash of its last bytes says so, chunks are deduplicated to verified identifiers, and
documents are compared by their ordered lists of identifiers. What moves is each distinct chunk once for each task that
holds it, and one short list for each document; a long document never moves as a whole.

* A null text counts as empty; an empty text has an empty recipe, and all empty texts are equal.
* A null ``doc_id`` is a row like any other; it stays only where its whole group has none.
* Rows that repeat a ``doc_id`` each get their row; all of them are ``kept`` where that id stays.
* Columns besides ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
"""

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baraza.llm.common import all_salts, cut, mix, salted, utf8

_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_LOOK_BACK = 32


def chunk_ends(data: np.ndarray, offsets: np.ndarray, least: int, mean: int, most: int) -> Iterator[list[int]]:
    """For each row the ends of its chunks. A cut depends on the 32 bytes before it; chunks hold ``least`` to ``most`` bytes."""
    gear = _GEAR[data]
    step = 1
    while step < _LOOK_BACK:  # after each round the hash covers twice as many bytes
        gear[step:] += gear[:-step] << np.uint32(step)
        step *= 2
    bits = max(1, (mean - least).bit_length() - 1)
    cuts = (np.flatnonzero(gear >> np.uint32(32 - bits) == 0) + 1).tolist()
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ends, at, i = [], start, bisect_left(cuts, start)
        while end - at > least:
            i = bisect_left(cuts, at + least, i)
            nearest = cuts[i] if i < len(cuts) else end
            at = min(nearest, at + most, end)
            ends.append(at)
        if at < end:
            ends.append(end)
        yield ends


def _chunks(batch: pa.RecordBatch, sizes: tuple[int, int, int], digest_size: int) -> Iterator[list[tuple[bytes, memoryview]]]:
    data, offsets = utf8(batch.column("text"))
    held = memoryview(data)
    for start, ends in zip(offsets[:-1].tolist(), chunk_ends(data, offsets, *sizes)):
        found = []
        for end in ends:
            chunk = held[start:end]
            found.append((hashlib.blake2b(chunk, digest_size=digest_size).digest(), chunk))
            start = end
        yield found


def chunk_recipes(docs: DataFrame, least: int = 256, mean: int = 1024, most: int = 8192, digest_size: int = 16) -> DataFrame:
    """``doc_id, text_sha256, n_chunks, recipe``: the ordered identifiers of each document's chunks, put end to end.

    An identifier is the chunk's digest. Chunks of unlike content that share a digest are told apart by a number that is
    appended with its place, so equal recipes mean equal texts, byte by byte.
    """
    if least < _LOOK_BACK:
        raise ValueError(f"a chunk needs {_LOOK_BACK} bytes at least, or cuts would depend on the text before")
    sizes = (least, mean, most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_sha256", F.sha2("text", 256))

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[digest for digest, _ in found] for found in _chunks(batch, sizes, digest_size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_sha256"), pa.array([len(x) for x in own], pa.int64()),
                 pa.array([b"".join(x) for x in own], pa.binary())], names=["doc_id", "text_sha256", "n_chunks", "recipe"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {(digest, bytes(chunk)) for found in _chunks(batch, sizes, digest_size) for digest, chunk in found}
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], pa.binary()) for k in (0, 1)], names=["digest", "content"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, *x) for i, found in enumerate(_chunks(batch, sizes, digest_size)) for k, x in enumerate(found)]
            of = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(of), batch.column("text_sha256").take(of), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.binary()), pa.array([bytes(r[3]) for r in rows], pa.binary())],
                names=["doc_id", "text_sha256", "place", "digest", "content"])

    kind = dict(docs.dtypes)["doc_id"]
    listed = texts.mapInArrow(recipes, f"doc_id {kind}, text_sha256 string, n_chunks long, recipe binary")
    store = texts.select("text").mapInArrow(contents, "digest binary, content binary").distinct()
    shared = cut(store.groupBy("digest").count().where("count > 1").select("digest"))
    if shared.isEmpty():
        return listed
    variants = (store.join(shared, "digest", "left_semi")
                .withColumn("variant", F.row_number().over(Window.partitionBy("digest").orderBy("content"))))
    told = (texts.mapInArrow(places, f"doc_id {kind}, text_sha256 string, place long, digest binary, content binary")
            .join(variants, ["digest", "content"]).select("doc_id", "text_sha256", "place", "variant").distinct()
            .groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_list(F.struct("place", "variant"))).alias("told")))
    mine, theirs = listed.alias("l"), told.alias("t")
    return mine.join(theirs, F.col("l.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("l.text_sha256") == F.col("t.text_sha256")), "left").select(
        "l.doc_id", "l.text_sha256", "l.n_chunks",
        F.concat("l.recipe", F.coalesce(F.to_json("t.told"), F.lit("")).cast("binary")).alias("recipe"))


def exact_groups(docs: DataFrame, **sizes: int) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per document; of equal texts the largest ``doc_id`` stays.

    A group may hold any share of the rows: it is counted before its rows are shuffled, and its rows meet the count
    under several salts.
    """
    recipes = salted(cut(chunk_recipes(docs, **sizes)), "doc_id")
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    joined = recipes.join(all_salts(groups), ["recipe", "salt"], "left")
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_exact(docs: DataFrame, **sizes: int) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that repeat an id and its text become one."""
    groups = cut(exact_groups(docs, **sizes))
    gone = groups.where(~F.col("kept")).select("doc_id", "text_sha256").distinct()
    d, g = docs.alias("d"), gone.alias("g")
    kept = d.join(g, (F.sha2(F.coalesce("d.text", F.lit("")), 256) == F.col("g.text_sha256")) & F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left_anti")
    again = groups.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
