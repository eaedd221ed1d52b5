"""Near-duplicates by BagMinHash signatures of shingle multisets, banded, verified and joined to classes.

A document is the multiset of its shingles of ``words`` lower-cased words (a shorter one is a single shingle). Weights are
whole numbers, discretised into the levels (0, 1], (1, 2], (2, 4], ...; each shingle and level owns a Poisson process whose
points fall on random registers, and a point counts where its level is within the shingle's weight. A register keeps its
earliest point, so two signatures agree in a register with the probability of the weighted Jaccard similarity. A process
is followed only while it can still lower a register of its document.

Texts that are equal are compared once. Each band links its documents to its hub, the document that shares bands with the
most others, unless their sketches - a bit of each register - differ in more bits than any pair of the threshold's
similarity would; links are verified on whole multisets, and classes grow from them. Bands that then still hold several
classes are cut into blocks, and each pair of blocks is a cell: one bounded task compares the sketches of all its pairs of
different classes and verifies the close ones on whole multisets, a pair in the first band that it shares. So every pair
of a band is of one class, apart by sketch, or verified; only verified links are written. The work in the cells grows with
the square of the number of documents that share a band without being of one class.

* A null or empty text has no shingles; all such documents are one class of equal texts.
* Documents with a null ``doc_id`` can't be named: their class is null, they are kept. Repeated rows of an id share its class.
* Columns besides ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baraza.llm.common import Rolling, byte_hashes, cut, mix, runs, slices, stored, utf8
from baraza.llm.components import components

BANDS, ROWS = 42, 6
#: Documents in a block of a band, about; a cell holds two blocks.
BLOCK = 512
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bags(texts: pa.Array, words: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of rows: the range, then ``row, shingle, weight`` of the distinct shingles, ordered by row."""
    data, offsets = utf8(texts)
    for a, b in slices(offsets):
        part = _LOWER[data[offsets[a]:offsets[b]]]
        starts, ends, first = runs(~_SPACE[part], offsets[a:b + 1] - offsets[a])
        n = np.diff(first)
        count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
        row = np.repeat(np.arange(b - a), count)
        at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        shingle = Rolling(byte_hashes(part).spans(starts, ends)).spans(at, np.minimum(at + words, first[row + 1]))
        order = np.lexsort((shingle, row))
        row, shingle = row[order], shingle[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
        head = np.flatnonzero(new)
        yield a, b, row[head], shingle[head], np.diff(np.append(head, len(row)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / 9007199254740992.0


def _step(n: int, by: int) -> np.uint64:
    return np.uint64(n * by % (1 << 64))


def signatures(rows: int, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """``m`` registers for each row: the times of the earliest points."""
    found = np.full(rows * m, np.inf)
    parts, level = [], 0
    while True:  # the processes of levels (0, 1], (1, 2], (2, 4], ...
        low = 0 if level == 0 else 1 << (level - 1)
        own = np.flatnonzero(weight > low)
        if not len(own):
            break
        parts.append((row[own], mix(shingle[own] + _step(level, 0xD1342543DE82EF95)), np.full(len(own), max(low, 1.0)), np.full(len(own), float(low)), weight[own].astype(float)))
        level += 1
    if not parts:
        return found.reshape(rows, m)
    doc, key, rate, low, most = (np.concatenate(x) for x in zip(*parts))
    time, point = np.zeros(len(doc)), 0
    while len(doc):
        point += 1
        draw = mix(key + _step(point, 0x9E3779B97F4A7C15))
        time = time - np.log(_uniform(draw)) / rate
        inside = (low == 0) | (low + _uniform(mix(draw + np.uint64(1))) * rate <= most)
        register = (mix(draw + np.uint64(2)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(found, (doc * m + register)[inside], time[inside])
        bound = found.reshape(rows, m).max(1)
        go = time < bound[doc]
        doc, key, rate, low, most, time = doc[go], key[go], rate[go], low[go], most[go], time[go]
    return found.reshape(rows, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each row and band."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    odd = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((mix(bits) * odd).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)).astype(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """One bit of each register, packed into whole numbers: unlike registers differ in it half of the time."""
    bits = (mix(signature.view(np.uint64)) & np.uint64(1)).astype(np.uint8)
    padded = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(padded, axis=1).view(np.int64)


def _apart(m: int, threshold: float) -> int:
    """Bits in which two sketches of ``m`` registers differ at the threshold, and five standard deviations more."""
    p = (1 - threshold) / 2
    return int(m * p + 5 * (m * p * (1 - p)) ** 0.5) + 1


def signed(texts: DataFrame, words: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc, text_sha256, keys array<long>, sketch array<long>`` of ``doc, text``; a text without shingles has no keys."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, packed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b, row, shingle, weight in bags(batch.column("text"), words):
                some = np.bincount(row, minlength=b - a) > 0
                signature = signatures(b - a, row, shingle, weight, bands * rows)
                keys.append(band_keys(signature, bands, rows)[some].ravel())
                packed.append(sketches(signature).ravel())
                counts.append(np.where(some, bands, 0))
            at = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            each = pa.array(np.arange(0, len(batch) + 1) * -(-bands * rows // 64), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text_sha256"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(keys))),
                                              pa.ListArray.from_arrays(each, pa.array(np.concatenate(packed)))], names=["doc", "text_sha256", "keys", "sketch"])
    return texts.withColumn("text_sha256", F.sha2("text", 256)).mapInArrow(sign, "doc long, text_sha256 string, keys array<long>, sketch array<long>")


def _whole(texts: pa.Array, words: int) -> list[np.ndarray]:
    """``row, shingle, weight`` of all rows."""
    parts = [(a + row, shingle, weight) for a, _, row, shingle, weight in bags(texts, words)]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]


def similarity(left: pa.Array, right: pa.Array, words: int = 5) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of each row; 1 for two texts without shingles."""
    (r1, s1, w1), (r2, s2, w2) = _whole(left, words), _whole(right, words)
    row, shingle, weight = np.concatenate([r1, r2]), np.concatenate([s1, s2]), np.concatenate([w1, w2])
    order = np.lexsort((shingle, row))
    row, shingle, weight = row[order], shingle[order], weight[order]
    same = np.flatnonzero((row[1:] == row[:-1]) & (shingle[1:] == shingle[:-1]))
    shared = np.bincount(row[same], np.minimum(weight[same], weight[same + 1]), len(left))
    union = np.bincount(row, weight, len(left)) - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, words: int = 5) -> DataFrame:
    """The pairs ``a, b`` of at least ``threshold``, with their ``similarity``, computed on whole texts; ``pairs`` is a stored table."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = similarity(batch.column("text_a"), batch.column("text_b"), words)
            good = pa.array(np.flatnonzero(found >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(good), batch.column("b").take(good), pa.array(found).take(good)], names=["a", "b", "similarity"])

    asked = stored(pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct(), "asked")
    own = texts.join(asked, "doc", "left_semi")
    both = (pairs.join(own.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
            .join(own.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long, similarity double")


def _links(shared: DataFrame, hubs: DataFrame, apart: int) -> DataFrame:
    """Pairs of each band's documents and its hubs whose sketches are close enough.

    ``hubs``: key, hub, hub_sketch. Both sides are stored tables, so a join can split a hot band.
    """
    pieces = [F.bit_count(F.get("sketch", F.lit(k)).bitwiseXOR(F.get("hub_sketch", F.lit(k)))) for k in range(-(-BANDS * ROWS // 64))]
    differ = sum((F.coalesce(p, F.lit(0)) for p in pieces), F.lit(0))
    near = (F.col("s.key") == F.col("h.key")) & (F.col("doc") != F.col("hub")) & (differ <= apart)
    return shared.alias("s").join(hubs.alias("h"), near).select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()


def _unsettled(cell: pa.Table, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a cell's two blocks that have different labels, close sketches and no earlier band in common."""
    n, i, j = len(cell), cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
    sketch, keys = (cell.column(c).combine_chunks().flatten().to_numpy().reshape(n, -1) for c in ("sketch", "keys"))
    sketch, label, block = sketch.view(np.uint64), cell.column("label").to_numpy(), cell.column("block").to_numpy()
    place = (keys == cell.column("key")[0].as_py()).argmax(1)
    others, left, right = np.flatnonzero(block == j), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    own = np.flatnonzero(block == i)
    for k in range(0, len(own), 64):
        some = own[k:k + 64]
        near = (np.bitwise_count(sketch[some, None] ^ sketch[None, others]).sum(2, dtype=np.int64) <= apart) & (label[some, None] != label[None, others])
        x, y = (side[at] for side, at in zip((some, others), np.nonzero(near)))
        if i == j:
            x, y = x[x < y], y[x < y]
        both = keys[x] == keys[y]
        new = ~(both.any(1) & (both.argmax(1) < place[x]))
        left.append(x[new])
        right.append(y[new])
    return np.concatenate(left), np.concatenate(right)


def _alike(texts: pa.Array, x: np.ndarray, y: np.ndarray, threshold: float, words: int) -> np.ndarray:
    """Whether the texts at ``x`` and ``y`` (ordered by ``x``) have at least ``threshold``; each text is cut into shingles once."""
    row, shingle, weight = _whole(texts, words)
    code = np.unique(shingle, return_inverse=True)[1]
    first, total = np.searchsorted(row, np.arange(len(texts) + 1)), np.bincount(row, weight, len(texts))
    held, good = np.zeros(len(code)), np.zeros(len(x), bool)
    heads = np.flatnonzero(np.diff(x, prepend=-1))
    for a, b in zip(heads, np.append(heads[1:], len(x))):
        mine = slice(first[x[a]], first[x[a] + 1])
        held[code[mine]] = weight[mine]
        size = first[y[a:b] + 1] - first[y[a:b]]
        step = max(1, (1 << 20) // max(1, size.max()))
        for c in range(a, b, step):
            mates = y[c:min(b, c + step)]
            n = size[c - a:c - a + len(mates)]
            at = np.repeat(first[mates] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(np.repeat(np.arange(len(mates)), n), np.minimum(held[code[at]], weight[at]), len(mates))
            good[c:c + len(mates)] = shared / np.maximum(total[x[a]] + total[mates] - shared, 1) >= threshold
        held[code[mine]] = 0
    return good


def _rest(rows: DataFrame, signed_once: DataFrame, texts: DataFrame, apart: int, threshold: float, words: int) -> DataFrame:
    """The links ``a, b`` between the labels of each band of ``rows`` (``key, doc, label``, stored), every pair compared.

    Tasks get whole cells; texts are joined only to documents that have a pair to verify in their cell.
    """
    several = stored(rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi")
                     .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "several")
    block = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    cells = (rows.join(several, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "label"))
    schema = "key long, i int, j int, block int, doc long, label long, sketch array<long>, keys array<long>"

    def needed(cell: pa.Table) -> pa.Table:
        return cell.take(pa.array(np.unique(np.concatenate(_unsettled(cell, apart)))))

    def judge(cell: pa.Table) -> pa.Table:
        x, y = _unsettled(cell, apart)
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        good = _alike(cell.column("text").combine_chunks(), x, y, threshold, words)
        doc = cell.column("doc").to_numpy()
        return pa.table({"a": np.minimum(doc[x], doc[y])[good], "b": np.maximum(doc[x], doc[y])[good]})

    order = [c.split()[0] for c in schema.split(", ")]
    asked = stored(cells.join(signed_once, "doc").select(order).groupBy("key", "i", "j").applyInArrow(needed, schema), "asked")
    return asked.join(texts, "doc").select(*order, "text").groupBy("key", "i", "j").applyInArrow(judge, "a long, b long")


def near_classes(docs: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """``doc_id, class_id, class_size, kept``: the class of near-duplicates of every document, named by its smallest id, which stays.

    A pair of similarity 0.8 shares a band with probability 1 - 3e-6, and its sketches pass with 1 - 3e-7.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    named = texts.where("doc IS NOT NULL")
    apart = _apart(BANDS * ROWS, threshold)
    marked = stored(signed(named, words), "signatures")
    # one document for each text; the id decides the minimum
    firsts = marked.groupBy("text_sha256").agg(F.min(F.struct("doc", "keys", "sketch")).alias("f")).select("f.*")
    bands = stored(firsts.select("doc", F.explode("keys").alias("key")), "bands")
    alive = stored(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "alive")
    once = stored(firsts.groupBy("doc").agg(F.min(F.struct("keys", "sketch")).alias("f")).select("doc", "f.*"), "once")
    shared = stored(bands.join(alive, "key").join(once.select("doc", "sketch"), "doc"), "shared")
    reach = stored(shared.groupBy("doc").agg(F.sum("n").alias("reach")), "reach")
    first = F.max(F.struct("reach", (-F.col("doc")).alias("order"), F.col("doc").alias("hub"), F.col("sketch").alias("hub_sketch")))
    hubs = stored(shared.join(reach, "doc").groupBy("key").agg(first.alias("h")).select("key", "h.hub", "h.hub_sketch"), "hubs")
    pairs = stored(_links(shared, hubs, apart), "pairs")
    links = stored(verified(pairs, named, threshold, words).select("a", "b"), "links")
    # bands that still hold several classes besides their hub: all their pairs
    labels = components(links).withColumnRenamed("id", "doc")
    classed = (shared.join(hubs.select("key", "hub"), "key").where("doc <> hub").join(labels, "doc", "left")
               .select("key", "doc", F.coalesce("class_id", "doc").alias("label")))
    rest = stored(_rest(stored(classed, "classed"), once, named, apart, threshold, words), "links")
    labels = components(links.union(rest))
    copies = marked.groupBy("text_sha256").agg(F.min("doc").alias("first"))
    by_copy = marked.select("doc", "text_sha256").join(copies, "text_sha256").groupBy("doc").agg(F.min("first").alias("first"))
    of = stored(by_copy.join(labels.withColumnRenamed("id", "first"), "first", "left").select("doc", F.coalesce("class_id", "first").alias("class_id")), "classes")
    sizes = stored(of.groupBy("class_id").agg(F.count("*").alias("class_size")), "sizes")
    joined = texts.select("doc").join(of.join(sizes, "class_id"), "doc", "left")
    return joined.select(F.col("doc").alias("doc_id"), "class_id", "class_size", F.col("doc").eqNullSafe(F.coalesce("class_id", "doc")).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one document for each class, with all their columns."""
    gone = near_classes(docs, **options).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
