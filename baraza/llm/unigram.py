"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces come from a public tokenizer's file, read once on the driver; the trie (a few MB, bounded by the vocabulary) goes
along with the tasks. A space is the whitespace marker, one is put before each text, and a character that no piece
covers is written as its UTF-8 bytes. No piece holds a marker behind another character, so the best path splits at words;
each distinct word of a slice of text is solved once, all words side by side.

Log scores: a file made for unigram models brings its own; one whose scores are merge ranks (all whole numbers) gets the
rank's Zipf probability, ``1 / (rank + 2.7)`` normalised. A fallback character costs 10 more than the rarest piece. Of equal
sums the path with the longer last piece wins, then the same rule before it.

* A null text has null ids and decodes to null; an empty text has no ids. ``decode(encode(text)) == text`` for every text,
  markers (U+2581) in the text included: they are written as bytes.
* Repeated rows and null ids of documents are rows like any other; other columns are kept by ``encode`` and ``decode``.
  A column of the same name as a result is replaced. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baraza.llm.common import byte_hashes, in_batches, slices, utf8

MARKER = "▁"
_LONG = 200
_WORST = -1e300


class Trie:
    """A double array: the child of ``state`` by byte ``c`` is ``base[state] + c`` if its ``check`` is ``state``."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, number in sorted(keys.items()):
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
            ends[node] = number
        room = 2 * len(children) + 1024
        self.base, self.check = np.zeros(room, np.int32), np.full(room, -1, np.int32)
        self.number = np.full(room, -1, np.int32)
        taken = bytearray(room)
        taken[0] = 1
        slot, waiting, near = {0: 0}, [0], 1
        for node in waiting:
            own = children[node]
            if not own:
                continue
            base = max(near - 256, 1)  # slots far behind are nearly full; searching them again would take quadratic time
            while any(taken[base + c] for c in own):
                base += 1
            if base + 1024 >= room:
                self.base = np.append(self.base, np.zeros(room, np.int32))
                self.check = np.append(self.check, np.full(room, -1, np.int32))
                self.number = np.append(self.number, np.full(room, -1, np.int32))
                taken.extend(bytes(room))
                room *= 2
            near = max(near, base)
            self.base[slot[node]] = base
            for c, child in own.items():
                taken[base + c] = 1
                self.check[base + c], slot[child] = slot[node], base + c
                waiting.append(child)
        for node, number in ends.items():
            self.number[slot[node]] = number

    def step(self, state, c):
        """The next states and whether they exist; for arrays or single values."""
        to = self.base[state] + c
        return to, self.check[to] == state


class Pieces:
    """A vocabulary: the bytes of each id, log scores, the ids of single bytes, and the trie."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], skip: set[int]):
        self.byte_ids = np.array(byte_ids, np.int32)
        of_byte = {i: b for b, i in enumerate(byte_ids)}
        raw = [bytes([of_byte[i]]) if i in of_byte else b"" if i in skip else p.replace(MARKER, " ").encode() for i, p in enumerate(pieces)]
        normal = [i for i in range(len(pieces)) if i not in of_byte and i not in skip]
        self.scores = np.full(len(pieces), _WORST)
        if all(float(scores[i]).is_integer() for i in normal):
            zipf = 1 / (np.arange(len(normal)) + 2.7)
            self.scores[normal] = np.log(zipf / zipf.sum())
        else:
            self.scores[normal] = [scores[i] for i in normal]
        self.fallback = float(self.scores[normal].min()) - 10
        self.trie = Trie({raw[i]: i for i in reversed(normal)})
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.alone = np.ones(256, bool)  # bytes that stand in no piece: words end before and after them
        for i in normal:
            self.alone[list(raw[i])] = False

    @classmethod
    def load(cls, path: str) -> "Pieces":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in ids]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        skip = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        inner = [p for p in names if MARKER in p.lstrip(MARKER)]
        if inner or skip & set(byte_ids):
            raise ValueError(f"{path}: pieces with a marker inside, or no byte pieces: {inner[:3]}")
        return cls(names, [model.get_score(i) for i in ids], byte_ids, skip)

    def best_path(self, unit: bytes) -> list[int]:
        """The ids of one word, position by position."""
        n, trie = len(unit), self.trie
        best, back = [0.0] + [_WORST] * n, [(0, 0)] * (n + 1)
        for p in range(n):
            if best[p] == _WORST:
                continue
            lead = unit[p]
            width = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            state, covered = 0, False
            for e in range(p, n):
                state, ok = trie.step(state, unit[e])
                if not ok:
                    break
                number = int(trie.number[state])
                if number >= 0:
                    covered |= e + 1 - p == width
                    if best[p] + self.scores[number] > best[e + 1]:
                        best[e + 1], back[e + 1] = best[p] + self.scores[number], (number, e + 1 - p)
            if not covered and best[p] + self.fallback > best[p + width]:
                best[p + width] = best[p] + self.fallback
                for e in range(p + 1, p + width + 1):
                    back[e] = int(self.byte_ids[unit[e - 1]]), 1
        ids = []
        while n:
            ids.append(back[n][0])
            n -= back[n][1]
        return ids[::-1]

    def best_paths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words and the number of ids of each."""
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        long = int(np.searchsorted(-lengths[order], -_LONG, "left"))
        paths = [np.array(self.best_path(data[starts[i]:ends[i]].tobytes()), np.int32) for i in order[:long].tolist()]
        ids, counts = self._side_by_side(data, starts[order[long:]], lengths[order[long:]])
        ids = np.concatenate([*paths, ids]) if paths else ids
        counts = np.concatenate([np.array([len(p) for p in paths], np.int64), counts])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return gather(ids, np.cumsum(counts) - counts, counts, back), counts[back]

    def _side_by_side(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``best_path`` for words from the longest to the shortest."""
        many = len(starts)
        if not many:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        trie, most = self.trie, int(lengths[0])
        best = np.full((most + 5, many), _WORST)
        best[0] = 0
        back_id, back_n = np.zeros((most + 5, many), np.int32), np.ones((most + 5, many), np.int8 if most < 128 else np.int16)
        last = len(data) - 1
        for p in range(most):
            act = np.flatnonzero(best[p, :int(np.searchsorted(-lengths, -p, "left"))] > _WORST)
            if not len(act):
                continue
            lead = data[starts[act] + p]
            width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            bare, slot = np.ones(len(act), bool), np.arange(len(act))
            state, u = np.zeros(len(act), np.int32), act
            for d in range(most - p):
                state, ok = trie.step(state, data[np.minimum(starts[u] + p + d, last)])
                ok &= p + d < lengths[u]
                state, u, slot = state[ok], u[ok], slot[ok]
                if not len(u):
                    break
                number = trie.number[state]
                hit = np.flatnonzero(number >= 0)
                if len(hit):
                    v, number = u[hit], number[hit]
                    bare[slot[hit[width[slot[hit]] == d + 1]]] = False
                    total = best[p, v] + self.scores[number]
                    better = total > best[p + d + 1, v]
                    v = v[better]
                    best[p + d + 1, v], back_id[p + d + 1, v], back_n[p + d + 1, v] = total[better], number[better], d + 1
            total = best[p, act] + self.fallback
            better = bare & (total > best[p + width, act])
            v, width = act[better], width[better]
            best[p + width, v] = total[better]
            for d in range(1, 5):
                x = v[width >= d]
                back_id[p + d, x], back_n[p + d, x] = self.byte_ids[data[starts[x] + p + d - 1]], 1
        at, left, steps = lengths.copy(), np.arange(many), []
        counts = np.zeros(many, np.int64)
        while len(left):
            steps.append((left, back_id[at[left], left]))
            counts[left] += 1
            at[left] -= back_n[at[left], left]
            left = left[at[left] > 0]
        ids, ends = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts)
        for k, (who, what) in enumerate(steps):
            ids[ends[who] - 1 - k] = what
        return ids, counts

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, end to end, and the number of ids of each row."""
        rows = len(offsets) - 1
        filled = np.diff(offsets) > 0
        shift = np.concatenate([[0], np.cumsum(filled)])
        own = offsets + shift  # each row that has bytes gets a marker in front
        text = np.full(int(own[-1]), 0x20, np.uint8)
        text[np.arange(len(data)) + np.repeat(np.cumsum(filled), np.diff(offsets))] = data
        n = len(text)
        if not n:
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        space, alone = text == 0x20, self.alone[text]
        new = np.zeros(n, bool)
        new[own[:-1][filled]] = True
        new[1:] |= (space[1:] & ~space[:-1]) | alone[1:] & (text[1:] < 0x80) | alone[:-1] & (text[:-1] < 0x80)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        _, first, word = np.unique(byte_hashes(text).spans(starts, ends), return_index=True, return_inverse=True)
        ids, counts = self.best_paths(text, starts[first], ends[first])
        per_unit = counts[word]
        totals = np.concatenate([[0], np.cumsum(per_unit)])
        bounds = totals[np.searchsorted(starts, own)]
        return gather(ids, np.cumsum(counts) - counts, counts, word), np.diff(bounds)

    def decode_row(self, ids: np.ndarray) -> str:
        raw = gather(self.bytes, self.begins, self.lengths, ids).tobytes()
        return raw[1:].decode(errors="replace") if raw[:1] == b" " else raw.decode(errors="replace")


def gather(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces ``flat[begins[i]:begins[i] + lengths[i]]`` for each ``i`` of ``which``, end to end."""
    n = lengths[which]
    ends = np.cumsum(n)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins[which] - (ends - n), n)]


def _with(schema: T.StructType, **columns: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema if f.name.lower() not in columns] + [T.StructField(k, v) for k, v in columns.items()])


def encode(docs: DataFrame, pieces: Pieces, column: str = "text", most: int = 1 << 21) -> DataFrame:
    """``docs`` with ``token_ids array<int>``. ``most``: bytes that are solved side by side."""
    base = docs.drop("token_ids")
    schema = _with(base.schema, token_ids=T.ArrayType(T.IntegerType()))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column)
            data, offsets = utf8(texts)
            found, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for a, b in slices(offsets, most):
                own, n = pieces.encode_rows(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                found.append(own)
                counts.append(n)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(found)), mask=texts.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], names=[*batch.schema.names, "token_ids"])

    return in_batches(base, ids, schema)


def decode(encoded: DataFrame, pieces: Pieces, column: str = "token_ids") -> DataFrame:
    """``encoded`` with ``decoded string``."""
    base = encoded.drop("decoded")
    schema = _with(base.schema, decoded=T.StringType())

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            known = lists.is_valid().to_pylist()
            own = [pieces.decode_row(flat[a:b]) if k else None for a, b, k in zip(at[:-1].tolist(), at[1:].tolist(), known)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string())], names=[*batch.schema.names, "decoded"])

    return in_batches(base, texts, schema)


def count_fallback(pieces: Pieces, column: str = "token_ids") -> F.Column:
    """How many ids of the list are single bytes; byte ids follow one another in the files."""
    lo, hi = int(pieces.byte_ids.min()), int(pieces.byte_ids.max())
    return F.size(F.filter(column, lambda x: x.between(lo, hi)))
