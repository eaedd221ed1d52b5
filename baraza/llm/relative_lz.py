"""Repeated passages by a relative Lempel-Ziv parse against indexed reference blocks.

The whole corpus is the reference. Each document is cut into blocks by its own content: a block is a run of windows (of
``window`` words) that share their smallest ``seed`` hash, so equal passages are cut alike wherever they stand. All blocks
are indexed by their seed. A document is factored block by block against the index: a block that stands earlier in the
reference as a whole continues the factor, and a block that meets an earlier one only in part - at the ends of a factor -
is compared window by window. Windows with an earlier occurrence become duplicate spans.

Work is linear in the number of words, whatever repeats: equal blocks and windows are merged inside each task before
they are shuffled, no pair of documents is ever written, and only blocks whose seed occurs again go beyond the count.

* A null or empty text has no words; a text shorter than a window is kept whole.
* A null ``doc_id`` counts as the smallest. Rows that repeat a ``doc_id`` are told apart by their text; equal rows
  are at the same place, so neither repeats the other.
* Columns besides ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baraza.llm.common import Rolling, byte_hashes, cut, runs, slices, stored, utf8

_NO_ID = -(1 << 63)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = pa.struct([("doc", pa.int64()), ("variant", pa.int64()), ("start", pa.int64())])
_FOUND = "seed long, print long, doc long, variant long, start long, n long, own boolean, others array<struct<doc: long, variant: long, start: long>>"
_NAMES = ["seed", "print", "doc", "variant", "start", "n", "own", "others"]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the number of each row's first word."""
    return runs(~_SPACE[data], offsets)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span < width:
        step = min(span, width - span)
        x = np.minimum(x[:-step], x[step:])
        span += step
    return x


def blocks_of(words: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """``row, start, n, seed, print, own`` of the blocks of all rows; ``start`` counts words in its row.

    ``words`` are the word hashes, ``first`` the bounds of the rows in them. ``print`` hashes all words of the block's
    windows. ``own`` marks blocks in which a seed comes twice, so that windows of one block may be equal.
    """
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none, none, none, none.astype(bool)
    rolling = Rolling(words)
    at = np.arange(len(words) - seed + 1)
    grams = rolling.spans(at, at + seed)
    width = window - seed + 1
    least = _sliding_min(grams, width)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:len(least)]
    valid = np.arange(len(least)) + window <= first[row + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new & valid)
    if not len(start):
        return none, none, none, none, none, none.astype(bool)
    closes = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid)
    n = closes - start + 1
    again = np.zeros(len(grams), np.int64)
    for d in range(1, width + 1):
        again[:-d] |= grams[:-d] == grams[d:]
    counted = np.concatenate([[0], np.cumsum(again)])
    own = counted[start + n + width - 1] > counted[start]
    held = rolling.spans(start, start + n - 1 + window)
    return row[start], start - first[row[start]], n, least[start].astype(np.int64), held.astype(np.int64), own


def _merged(seed, held, doc, variant, start, n, own) -> pa.RecordBatch:
    """One row for each ``(seed, print)`` with its first place; the other places go along in a list."""
    order = np.lexsort((start, doc, held, seed))
    seed, held, doc, variant, start, n, own = (x[order] for x in (seed, held, doc, variant, start, n, own))
    new = np.ones(len(seed), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (held[1:] != held[:-1])
    head = np.flatnonzero(new)
    rest = np.flatnonzero(~new)
    bounds = np.searchsorted(rest, np.append(head, len(seed)))
    others = pa.ListArray.from_arrays(
        pa.array(bounds, pa.int32()),
        pa.StructArray.from_arrays([pa.array(x[rest]) for x in (doc, variant, start)], fields=list(_PLACE)))
    return pa.RecordBatch.from_arrays([pa.array(x[head]) for x in (seed, held, doc, variant, start, n, own)] + [others], names=_NAMES)


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc, variant, text``; the variant tells apart unlike texts of one id."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    if keyed.groupBy("doc").count().where("count > 1").isEmpty():
        return keyed.withColumn("variant", F.lit(0).cast("long"))
    return keyed.withColumn("variant", F.dense_rank().over(Window.partitionBy("doc").orderBy("text")).cast("long"))


def _hashed(batch: pa.RecordBatch):
    """For slices of a batch: row range, word hashes, first word of each row."""
    data, offsets = utf8(batch.column("text"))
    for a, b in slices(offsets):
        part = data[offsets[a]:offsets[b]]
        starts, ends, first = word_spans(part, offsets[a:b + 1] - offsets[a])
        yield a, b, byte_hashes(part).spans(starts, ends), first


def _blocks(window: int, seed: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            doc, variant = (batch.column(c).to_numpy() for c in ("doc", "variant"))
            for a, b, words, first in _hashed(batch):
                row, start, n, seeds, held, own = blocks_of(words, first, window, seed)
                parts.append((seeds, held, doc[a:b][row], variant[a:b][row], start, n, own))
            if parts:
                yield _merged(*(np.concatenate(x) for x in zip(*parts)))
    return blocks


def _windows(window: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            doc, variant = (batch.column(c).to_numpy() for c in ("doc", "variant"))
            asked = batch.column("asked")
            for a, b, words, first in _hashed(batch):
                lists = asked.slice(a, b - a)
                flat = lists.flatten()
                row = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
                start, n, seeds = (flat.field(k).to_numpy() for k in range(3))
                each = np.repeat(np.arange(len(n)), n)
                at = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                row = row[each]
                held = Rolling(words).spans(first[row] + at, first[row] + at + window).astype(np.int64)
                parts.append((seeds[each], held, doc[a:b][row], variant[a:b][row], at, np.ones(len(at), np.int64), np.zeros(len(at), bool)))
            if parts:
                yield _merged(*(np.concatenate(x) for x in zip(*parts)))
    return windows


def _earlier(found: DataFrame) -> DataFrame:
    """Of rows merged by task: each run of windows that stands earlier, with its first place, and (``nth`` 1) the first places."""
    same = Window.partitionBy("seed", "print").orderBy("doc", "start", "variant")
    ranked = (found.withColumn("ref_doc", F.first("doc").over(same)).withColumn("ref_start", F.first("start").over(same))
              .withColumn("nth", F.row_number().over(same)))
    own = F.array(F.struct("doc", "variant", "start", "nth"))
    others = F.transform("others", lambda p: F.struct(p["doc"].alias("doc"), p["variant"].alias("variant"), p["start"].alias("start"), F.lit(0).alias("nth")))
    return ranked.select("seed", "partly", "ref_doc", "ref_start", "n", F.explode(F.concat(own, others)).alias("p")).select(
        "p.*", "seed", "partly", "n", "ref_doc", "ref_start")


def repeated_runs(keyed: DataFrame, window: int = 20, seed: int = 5) -> DataFrame:
    """``doc, variant, start, n, ref_doc, ref_start``: ``n`` windows from word ``start`` on that stand earlier at the given place."""
    blocks = keyed.mapInArrow(_blocks(window, seed), _FOUND)
    weight = 1 + F.size("others") + F.col("own").cast("int")
    seeds = cut(blocks.groupBy("seed").agg(F.min("print").alias("lo"), F.max("print").alias("hi"), F.sum(weight).alias("weight"), F.max("own").alias("twice"))
                .where("weight > 1").select("seed", (F.col("twice") | (F.col("lo") < F.col("hi"))).alias("partly")))
    later = (F.col("doc") > F.col("ref_doc")) | ((F.col("doc") == F.col("ref_doc")) & (F.col("start") > F.col("ref_start")))
    whole = stored(_earlier(blocks.drop("own").join(seeds, "seed").repartition("seed", "print"))
                   .where(later | ((F.col("nth") == 1) & F.col("partly"))), "blocks")
    asked = (whole.where((F.col("nth") == 1) & F.col("partly")).groupBy("doc", "variant")
             .agg(F.collect_list(F.struct("start", "n", "seed")).alias("asked")))
    windows = keyed.join(asked, ["doc", "variant"]).select("doc", "variant", "text", "asked").mapInArrow(_windows(window), _FOUND)
    part = _earlier(windows.withColumn("partly", F.lit(False)))
    return whole.unionByName(part).where(later).select("doc", "variant", "start", "n", "ref_doc", "ref_start")


def factors(docs: DataFrame, window: int = 20, seed: int = 5) -> DataFrame:
    """``doc_id, start, length, ref_doc_id, ref_start``: each document's factors of ``window`` words or more, in words.

    A factor is extended greedily while the reference goes on at the next word; its reference is the earliest place.
    """
    found = repeated_runs(_keyed(docs), window, seed)
    shift = F.col("ref_start") - F.col("start")
    line = Window.partitionBy("doc", "variant", "ref_doc", "shift").orderBy("start")
    opens = F.col("start") > F.lag(F.col("start") + F.col("n")).over(line)
    return (found.withColumn("shift", shift).withColumn("opens", F.coalesce(opens, F.lit(True)).cast("int"))
            .withColumn("piece", F.sum("opens").over(line)).groupBy("doc", "variant", "ref_doc", "shift", "piece")
            .agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) - F.min("start") + window - 1).alias("length"))
            .select(_id("doc").alias("doc_id"), "start", "length", _id("ref_doc").alias("ref_doc_id"), (F.col("start") + F.col("shift")).alias("ref_start")))


def _id(name: str) -> F.Column:
    return F.when(F.col(name) != _NO_ID, F.col(name))


def without_repeats(docs: DataFrame, window: int = 20, seed: int = 5) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: each text without the words of its repeated windows, joined by single spaces."""
    keyed = _keyed(docs)
    spans = repeated_runs(keyed, window, seed).groupBy("doc", "variant").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans")):
                words = text.encode().split()  # at ASCII white space
                total.append(len(words))
                if spans.is_valid:
                    start, n = (spans.values.field(k).to_numpy() for k in range(2))
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + n - 1 + window, -1)
                    stay = np.cumsum(change)[:-1] == 0
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=["doc", "n_words", "n_removed", "kept"])

    joined = keyed.join(spans, ["doc", "variant"], "left").select("doc", "text", "spans")
    return joined.mapInArrow(strip, "doc long, n_words long, n_removed long, kept string").select(_id("doc").alias("doc_id"), "n_words", "n_removed", "kept")
