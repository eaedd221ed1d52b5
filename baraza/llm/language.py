"""Language identification by a linear-chain conditional random field over words.

A word's emission scores come from hashed affixes, byte n-grams with word ends, and the word itself; learned transitions
tie neighbours, and forward-backward gives each word of a text - code-switched or not - its probabilities by language. A
document's language is the one that holds most of its letters, its score that share.

The field is fitted on the driver from a bounded sample: at most ``sample_docs`` labelled rows (those of the smallest hash of
``doc_id``), ``sample_words`` consecutive words of each. Half of the training sequences join pieces of two documents, which
teaches the transitions. Its size is fixed: ``2 ** bits`` rows of one weight per language, sent with the tasks.

* A null text, or one without a letter, is ``und`` with score 0; so is every text if no row has a label.
* A null ``doc_id`` is predicted like any other row, is never learned from and not held out. Repeated rows are predicted alike.
* ``lang`` and ``doc_id`` choose what is learned and never enter a prediction. Ties go to the first language by name.
* Other columns are ignored by ``identify``, kept as they are by ``keep_known``, also those named like its own; an empty table gives an empty result.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baraza.llm.common import byte_hashes, in_batches, runs, slices, utf8

NONE = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[0x80:] = True
_AT_ONCE = 1 << 20  # bytes of text whose words are scored at once, which bounds a worker's memory
_GROUP = 200_000  # words whose messages are held at once


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # feature, language
    moves: np.ndarray  # log score of one language after another
    opens: np.ndarray

    @property
    def bits(self) -> int:
        return int(self.weights.shape[0]).bit_length() - 1

    def emissions(self, word: np.ndarray, feature: np.ndarray, many: int) -> np.ndarray:
        n = np.maximum(np.bincount(word, minlength=many), 1)
        return np.stack([np.bincount(word, self.weights[feature, k], many) / n for k in range(len(self.languages))], 1)


def _spans(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes; starts, ends and hashes of the words; each row's first word."""
    lower = _LOWER[data]
    starts, ends, first = runs(_LETTER[lower], offsets)
    return lower, starts, ends, byte_hashes(lower).spans(starts, ends), first


def features(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(word, feature)`` of distinct words."""
    lengths = np.array([len(w) for w in words], np.int64)
    text = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths
    rolling, number = byte_hashes(text), np.arange(len(words))
    word, hashes = [number, number, number], [
        rolling.spans(starts, ends) + np.uint64(1), rolling.spans(starts, np.minimum(starts + 3, ends)) + np.uint64(2),
        rolling.spans(np.maximum(ends - 3, starts), ends) + np.uint64(3)]
    for n in (2, 3, 4):  # with the blanks around the word
        count = np.maximum(lengths + 3 - n, 0)
        owner = np.repeat(number, count)
        at = starts[owner] - 1 + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        word.append(owner)
        hashes.append(rolling.spans(at, at + n) + np.uint64(3 + n))
    return np.concatenate(word), (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def _fit(pieces: np.ndarray, labels: np.ndarray, words: list[bytes], languages: list[str], bits: int, rounds: int) -> Field:
    """``pieces``: word numbers, one row of equal length per piece; ``labels``: the language of each."""
    many, width, k = len(words), pieces.shape[1], len(languages)
    draw = np.random.default_rng(1)
    other = draw.permutation(len(pieces))
    keep = draw.random(len(pieces)) < 0.5
    other = np.where(keep, np.arange(len(pieces)), other)
    seq = np.concatenate([pieces, pieces[other]], 1)
    gold = np.concatenate([np.repeat(labels[:, None], width, 1), np.repeat(labels[other][:, None], width, 1)], 1)
    word, feature = features(words, bits)
    share = 1 / np.maximum(np.bincount(word, minlength=many), 1)
    field = Field(languages, np.zeros((1 << bits, k)), np.zeros((k, k)), np.zeros(k))
    past = [np.full_like(x, 1e-8) for x in (field.weights, field.moves, field.opens)]
    for _ in range(rounds):
        e = np.exp(field.emissions(word, feature, many))[seq]
        move = np.exp(field.moves)
        ahead, behind = np.empty_like(e), np.ones_like(e)
        ahead[:, 0] = np.exp(field.opens) * e[:, 0]
        for t in range(seq.shape[1]):
            if t:
                ahead[:, t] = (ahead[:, t - 1] @ move) * e[:, t]
            ahead[:, t] /= ahead[:, t].sum(1, keepdims=True)
        for t in range(seq.shape[1] - 2, -1, -1):
            behind[:, t] = (e[:, t + 1] * behind[:, t + 1]) @ move.T
            behind[:, t] /= behind[:, t].sum(1, keepdims=True)
        post = ahead * behind
        post /= post.sum(2, keepdims=True)
        moved = np.zeros((k, k))
        for t in range(seq.shape[1] - 1):
            pair = ahead[:, t, :, None] * move * (e[:, t + 1] * behind[:, t + 1])[:, None, :]
            moved -= (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            np.add.at(moved, (gold[:, t], gold[:, t + 1]), 1)
        miss = np.eye(k)[gold] - post
        by_word = np.stack([np.bincount(seq.ravel(), miss[:, :, j].ravel(), many) for j in range(k)], 1) * share[:, None]
        slope = [np.stack([np.bincount(feature, by_word[word, j], 1 << bits) for j in range(k)], 1) - 1e-3 * field.weights,
                 moved - 1e-3 * field.moves, miss[:, 0].sum(0) - 1e-3 * field.opens]
        for value, g, h in zip((field.weights, field.moves, field.opens), slope, past):
            h += g * g
            value += 0.5 * g / np.sqrt(h)
    field.weights = field.weights.astype(np.float32)
    return field


def fit(docs: DataFrame, sample_docs: int = 2000, sample_words: int = 64, bits: int = 16, rounds: int = 30, piece: int = 12) -> Field | None:
    """The field learned from labelled rows outside the held-out third; null if there are none."""
    from_ = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).withColumn("rank", F.xxhash64(F.col("doc_id").cast("string")))
    bound = from_.select("rank").orderBy("rank").limit(sample_docs).agg(F.max("rank")).first()[0]
    if bound is None:
        return None
    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w != "")
    start = 1 + F.pmod(F.col("rank"), F.greatest(F.size("words") - sample_words, F.lit(0)) + 1).cast("int")
    rows = (from_.where(F.col("rank") <= bound).select("lang", "rank", words.alias("words")).where(F.size("words") > 0)
            .select("lang", "rank", F.concat_ws(" ", F.slice("words", start, sample_words)).alias("text")).orderBy("rank", "lang", "text").limit(sample_docs).collect())
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    known: dict[bytes, int] = {}
    pieces, labels = [], []
    for k, lang in enumerate(languages):
        stream = [known.setdefault(w, len(known)) for r in rows if r.lang == lang for w in
                  (bytes(_LOWER[np.frombuffer(x.encode(), np.uint8)]) for x in r.text.split(" "))]
        stream = (stream * piece)[:piece] if len(stream) < piece else stream
        for at in range(0, len(stream) - piece + 1, piece):
            pieces.append(stream[at:at + piece])
            labels.append(k)
    return _fit(np.array(pieces), np.array(labels), list(known), languages, bits, rounds)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _messages(field: Field, index: np.ndarray, lengths: np.ndarray, first: np.ndarray, e: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each row's sum of its words' probabilities by language, times the words' weights. Rows come from long to short.

    ``index`` numbers the distinct word at each place, ``e`` holds the exponentials of their emissions.
    """
    k, steps = len(field.languages), int(lengths[0])
    at = np.searchsorted(-lengths, -np.arange(steps), "left")  # rows that reach each step
    begins = np.concatenate([[0], np.cumsum(at)])
    turn = np.repeat(np.arange(steps), at)
    place = first[np.arange(len(turn)) - begins[turn]] + turn
    own, heavy = e[index[place]], weight[index[place]]
    move = np.exp(field.moves).astype(np.float32)
    ahead = np.empty((len(turn), k), np.float32)
    ahead[:at[0]] = np.exp(field.opens) * own[:at[0]]
    for t in range(steps):
        a, b = begins[t], begins[t + 1]
        if t:
            ahead[a:b] = (ahead[begins[t - 1]:begins[t - 1] + b - a] @ move) * own[a:b]
        ahead[a:b] /= ahead[a:b].sum(1, keepdims=True)
    total = np.zeros((len(lengths), k))
    behind = np.ones((len(lengths), k), np.float32)
    for t in range(steps - 1, -1, -1):
        a, b = begins[t], begins[t + 1]
        now = behind[:b - a]
        post = ahead[a:b] * now
        total[:b - a] += post * (heavy[a:b] / post.sum(1))[:, None]
        now = (own[a:b] * now) @ move.T
        behind[:b - a] = now / now.sum(1, keepdims=True)
    return total


def letters_by_language(texts: pa.Array, field: Field) -> np.ndarray:
    """For each text the expected letters of each language."""
    data, offsets = utf8(texts)
    hashes, sizes, examples = [], [], {}
    for a, b in slices(offsets):
        lower, starts, ends, h, first = _spans(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        raw = lower.tobytes()
        for x, i in zip(*(y.tolist() for y in np.unique(h, return_index=True))):
            if x not in examples:
                examples[x] = raw[starts[i]:ends[i]]
        hashes.append(h)
        sizes.append(np.diff(first))
    total = np.zeros((len(texts), len(field.languages)))
    if not examples:
        return total
    order = np.array(sorted(examples), np.uint64)
    index = np.searchsorted(order, np.concatenate(hashes))
    words = [examples[x] for x in order.tolist()]
    scores = field.emissions(*features(words, field.bits), len(words))
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float32)
    weight = np.array([len(w) for w in words], np.float64)
    lengths = np.concatenate(sizes)
    first = np.cumsum(lengths) - lengths
    rows = np.argsort(-lengths, kind="stable")
    rows = rows[lengths[rows] > 0]
    held = np.cumsum(lengths[rows]) // _GROUP
    for part in np.split(rows, np.flatnonzero(np.diff(held)) + 1) if len(rows) else []:
        total[part] = _messages(field, index, lengths[part], first[part], e, weight)
    return total


def predict(docs: DataFrame, field: Field | None, lang: str = "lang_pred", share: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its share of the letters; columns of these names are replaced."""
    docs = docs.drop(lang, share)
    if field is None:
        return docs.withColumn(lang, F.lit(NONE)).withColumn(share, F.lit(0.0))
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + [f"`{lang}` string", f"`{share}` double"])
    names = np.array(field.languages, object)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            parts = [letters_by_language(batch.column("text").slice(a, b - a), field) for a, b in slices(offsets, _AT_ONCE)]
            total = np.concatenate([np.zeros((0, len(names))), *parts])
            all_ = total.sum(1)
            best = total.argmax(1)
            some = all_ > 0
            score = np.where(some, np.minimum(total[np.arange(len(best)), best] / np.where(some, all_, 1), 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(some, names[best], NONE), pa.string()), pa.array(score)],
                                             names=[*batch.schema.names, lang, share])

    found = in_batches(docs, label, schema)
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.withColumn(share, F.when(known, F.col(share)).otherwise(0.0)).withColumn(lang, F.when(known, F.col(lang)).otherwise(NONE))


def identify(docs: DataFrame, **sample: int) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, fit(docs.select("doc_id", "text", "lang"), **sample)).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, **sample: int) -> DataFrame:
    """The rows of ``docs`` whose text is in a language at all: those not ``und``; where ``lang`` is null it becomes the predicted
    one. Other columns stay as they are. If nothing is labelled, none is rejected or filled in."""
    field = fit(docs.select("doc_id", "text", "lang"), **sample)
    if field is None:
        return docs
    told = predict(docs, field, "_lang_pred", "_share").where(F.col("_lang_pred") != NONE)
    return told.withColumn("lang", F.coalesce("lang", "_lang_pred")).select(*docs.columns)
