"""Phrases of few words that occur more often than their parts suggest, mined by Rabin-Karp fingerprints.

Each word is hashed from a prefix polynomial over the bytes, each run of words from a second one over the words' hashes; the
language is part of a fingerprint. Three scans of the texts, none of which moves a text:

1. fingerprints of one and two words, summed inside the task and then by a shuffle; what is frequent goes into a bit filter of
   fixed size. A longer phrase is at most as frequent as the pairs in it, so
2. fingerprints of longer runs are made only where every pair in them passes the filter, and summed likewise;
3. where a fingerprint passes the filter, its occurrence pointers (places in the block of texts) are followed: occurrences with
   one fingerprint are compared word by word, byte by byte, and only these phrases are materialised. They are summed by their
   text, so neither a collision nor a false hit of the filter can change a count.

A count behind a collision is only too large, so nothing frequent is ever lost; when a corpus is so large that the filter
fills up, more phrases are materialised and then fall below the bound, and the result stays the same.

* ``A-Z`` become lower case; pieces end at ``[.,;:!?\\n\\v\\f\\r]`` and at the end of a text, words at blanks and tabs.
* A null text has no words; a null language counts as ``und``. Repeated rows count as often as they come.
* An empty table gives no rows; columns other than ``lang`` and ``text`` are ignored. Texts and words of any length are taken whole.
* Ties: of cuts with the lowest score the shortest first part; of phrases with equal score and count the smaller in UTF-8.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baraza.llm.common import Rolling, byte_hashes, in_batches, mix, runs, slices, stored, utf8

ENDS, GAPS = ".,;:!?\n\x0b\x0c\r", " \t"
FILTER_BITS = 1 << 28  # 32 MB, however large the corpus
PROBES = 4
BLOCK_BYTES = 1 << 20  # of text hashed at once
HELD_PRINTS = 1 << 20  # summed inside the task at once
PRINT_BITS = 40  # of a fingerprint: what is shuffled is five bytes of it and its count

_END = np.zeros(256, bool)
_END[[ord(c) for c in ENDS]] = True
_BREAK = _END.copy()
_BREAK[[ord(c) for c in GAPS]] = True


class Block:
    """The words of some texts: their bytes, hashes, pieces and rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, tags: np.ndarray, mask: np.uint64):
        self.data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.starts, self.ends, _ = runs(~_BREAK[self.data], offsets)
        self.rows = np.searchsorted(offsets, self.starts, "right") - 1
        self.hashes = byte_hashes(self.data).spans(self.starts, self.ends) & mask
        # a piece is told by its row and by how many ends stand before it
        self.pieces = np.cumsum(_END[self.data], dtype=np.int64)[self.starts] + (self.rows << 40) if len(data) else self.starts
        self.tags, self.mask, self.rolling = tags, mask, Rolling(self.hashes)

    def fingerprints(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a run of ``size`` words of one piece starts, and its fingerprint."""
        n = len(self.starts) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.pieces[:n] == self.pieces[size - 1:])
        return at, mix(self.rolling.spans(at, at + size) ^ self.tags[self.rows[at]]) & self.mask


def _position(prints: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return mix(prints + np.uint64(probe * Rolling.BASE % (1 << 64))) & np.uint64(bits - 1)


def _passes(words: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which fingerprints may be in the filter ``words``."""
    left = np.arange(len(prints))
    for i in range(PROBES):
        p = _position(prints[left], i, len(words) * 64)
        left = left[(words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
    found = np.zeros(len(prints), bool)
    found[left] = True
    return found


def _blocks(batches: Iterator[pa.RecordBatch], mask: np.uint64):
    """Blocks of at most ``BLOCK_BYTES`` of text, or one longer text, with their rows' languages."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        tags = byte_hashes(utf8(batch.column("lang"))[0]).spans(*(lambda o: (o[:-1], o[1:]))(utf8(batch.column("lang"))[1]))
        for a, b in slices(offsets, BLOCK_BYTES):
            yield Block(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], tags[a:b], mask), batch.slice(a, b - a)


def _counted(sizes: list[int], mask: np.uint64, known=None):
    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["print", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for block, _ in _blocks(batches, mask):
            pairs = None
            if known is not None:
                at, prints = block.fingerprints(2)
                pairs = np.zeros(len(block.starts) + 1, bool)
                pairs[at[_passes(known.value, prints)]] = True
            for size in sizes:
                at, prints = block.fingerprints(size)
                if pairs is not None:
                    fit = np.ones(len(at), bool)
                    for i in range(size - 1):
                        fit &= pairs[at + i]
                    prints = prints[fit]
                held.append(prints)
                n += len(prints)
            if n > HELD_PRINTS:
                yield summed(held)
                held, n = [], 0
        if n:
            yield summed(held)
    return count


def _filter(frequent: DataFrame, bits: int) -> np.ndarray:
    """The bit filter of a table of fingerprints: made by tasks, at most ``bits / 64`` rows come to the driver."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(PROBES):
                p = _position(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), i, bits)
                yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)),
                                                  pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    found = in_batches(frequent, spread, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


def _same_bytes(data: np.ndarray, start: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``data`` holds the same ``length`` bytes from ``start`` as from ``other``, for each triple."""
    ends = np.cumsum(length)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
    unlike = data[np.repeat(start, length) + within] != data[np.repeat(other, length) + within]
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(unlike)])
    return total[ends] == total[ends - length]


def _word_ids(block: Block) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, equal only for words of equal bytes, and the words by number."""
    _, first, ids = np.unique(block.hashes, return_index=True, return_inverse=True)
    length, model = block.ends - block.starts, first[ids]
    same = length == length[model]
    check = np.flatnonzero(same & (model != np.arange(len(model))))
    same[check] = _same_bytes(block.data, block.starts[check], block.starts[model[check]], length[check])
    cut = [block.data[s:e].tobytes() for s, e in zip(block.starts[first].tolist(), block.ends[first].tolist())]
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():  # words that share a hash but not their bytes
        word = block.data[block.starts[i]:block.ends[i]].tobytes()
        ids[i] = others.setdefault(word, len(cut) + len(others))
    return ids, cut + list(others)


def _materialised(longest: int, mask: np.uint64, known):
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches, mask):
            langs = rows.column("lang").to_pylist()
            code = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
            codes, names = np.array([code[x] for x in langs], np.int64), list(code)
            words = np.bincount(codes[block.rows], minlength=len(names)) if len(names) else np.zeros(0, np.int64)
            yield _rows(names, [b""] * len(names), words)
            ids, cut = _word_ids(block)
            before = np.ones(len(block.starts) + 1, bool)  # where a run of one word less passed
            for size in range(1, longest + 1):
                at, prints = block.fingerprints(size)
                fit = before[at] & before[at + 1] if size > 1 else before[at]
                at, prints = at[fit], prints[fit]
                keep = _passes(known.value, prints)
                at, prints = at[keep], prints[keep]
                before = np.zeros_like(before)
                before[at] = True
                if not len(at):
                    continue
                order = np.argsort(prints, kind="stable")
                at, prints = at[order], prints[order]
                lead = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
                parts = [codes[block.rows[at]], *(ids[at + i] for i in range(size))]
                model = np.repeat(lead, np.diff(np.append(lead, len(at))))
                if not all(np.array_equal(p, p[model]) for p in parts):  # unlike phrases share a fingerprint: group by their words
                    order = np.lexsort(parts)
                    at, parts = at[order], [p[order] for p in parts]
                    lead = np.flatnonzero(np.concatenate([[True], np.any([p[1:] != p[:-1] for p in parts], axis=0)]))
                counts = np.diff(np.append(lead, len(at)))
                texts = [b" ".join([cut[w] for w in row]) for row in zip(*(p[lead].tolist() for p in parts[1:]))]
                yield _rows([names[c] for c in parts[0][lead].tolist()], texts, counts)
    return follow


def _rows(langs, texts, counts) -> pa.RecordBatch:
    """The empty phrase stands for all words of a language."""
    return pa.RecordBatch.from_arrays([
        pa.array(langs, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.asarray(counts, np.int64))], names=["lang", "phrase", "a"])


def frequent_phrases(docs: DataFrame, *, least: int = 30, longest: int = 4, filter_bits: int = FILTER_BITS, print_bits: int = PRINT_BITS) -> DataFrame:
    """``lang, phrase, size, a``: every run of 1 to ``longest`` words that occurs at least ``least`` times and its exact count, and per
    language one row of size 0 with all its words.

    ``filter_bits``, a power of two, bounds what is broadcast. ``print_bits`` bounds what a fingerprint adds to a shuffle: of ten to the eighth frequent
    phrases one rare fingerprint in ten thousand meets one and is materialised in vain. It is smaller only in tests.
    """
    spark = docs.sparkSession
    mask = np.uint64((1 << print_bits) - 1)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")

    def frequent(sizes: list[int], known=None) -> np.ndarray:
        counts = in_batches(texts, _counted(sizes, mask, known), "print long, n long")
        return _filter(counts.groupBy("print").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("print"), filter_bits)

    words = frequent([1, 2])
    if longest > 2:
        words |= frequent(list(range(3, longest + 1)), spark.sparkContext.broadcast(words))
    known = spark.sparkContext.broadcast(words)
    found = in_batches(texts, _materialised(longest, mask, known), "lang string, phrase string, a long")
    counts = found.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return stored(counts.where((F.col("a") >= least) | (F.col("phrase") == "")).withColumn("size", size), "phrases")


def _part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, *, least: int = 30, longest: int = 4, best: int = 2000, **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``best`` phrases of 2 words or more.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its weakest cut, ``n`` the language's words; the score is
    ``floor(2000000 * a / (l + r))`` there. A phrase inside a longer one that is at least 0.8 times as frequent is left out.
    """
    found = frequent_phrases(docs, least=least, longest=longest, **options)
    totals = found.where("size = 0").select("lang", F.col("a").alias("n"))
    phrases = found.where("size >= 2").select("lang", "phrase", "size", "a", F.split("phrase", " ").alias("words"))
    parts = found.where(F.col("size").between(1, longest - 1)).select("lang", "phrase", "a")

    # what a longer phrase stands for goes first, so it is neither cut nor joined
    inside = phrases.where("size >= 3").select("lang", F.col("a").alias("longer"), "words", "size", F.explode(F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(words, i, m), ' '))))")).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.select("lang", "phrase", "a").join(inside, ["lang", "phrase"], "left").where(
        "longer IS NULL OR CAST(longer AS decimal(19,0)) * 100 < CAST(a AS decimal(19,0)) * 80")

    # a cut is told by its two parts alone; a part is at least as frequent as the whole, so every part is found
    words = kept.select("lang", "a", F.split("phrase", " ").alias("words"))
    cuts = words.select("lang", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "a", _part(F.col("words"), F.lit(1), F.col("k")).alias("head"), _part(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    cuts = (cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
            .join(parts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"]))
    exact = "CAST(2000000 AS decimal(7,0)) * CAST(a AS decimal(19,0)) div (CAST(l AS decimal(19,0)) + CAST(r AS decimal(19,0)))"
    cut = F.struct(F.expr(exact).alias("score"), F.size(F.split("head", " ")).alias("k"), "l", "r")
    scored = cuts.groupBy("lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "a").agg(F.min(cut).alias("cut"))

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n",
                                              F.col("cut.score").cast("long").alias("score"))
