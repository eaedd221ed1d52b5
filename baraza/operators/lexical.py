"""Full-text matching: documents that hold any of a query's content terms, ranked, best ``k`` kept.

The rank is the mean over the query's distinct terms of a saturating term frequency, scaled to at most 1.
Stems are matched by spelling out the query's stems. For a counted, bounded table of query terms, documents stream past the broadcast
terms and only the best ``k`` per query leave a task: no term is exploded, no (query, document) pair is shuffled. Documents are bits of words
there, 64 of which are counted by one operation. A larger
query table is taken in parts of that size, one pass over the documents for each. ``lexical_matches`` gives all matches, by joins on the
term, for those who want all of them.
"""

import math
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baraza.operators.blocked import CELLS, RESCORED, SCALE, BestPerQuery, in_passes, scan
from baraza.operators.topk import top_k
from baraza.session import run_folder

_FULL = 6 / math.pi ** 2  # 1 / (1 + 1/4 + 1/9 + ...): a term repeated without end scores 1
BROADCAST_TERMS = 2_000_000
BROADCAST_QUERIES = 50_000
LEAST = 1e-9  # less than the rank of one term in any query
SLAB_TERMS, SLAB_ROWS = 1 << 19, 4096  # terms of documents coded and documents counted at once
SLAB_BYTES = 32 << 20  # of the bits of some documents' terms; of more, fewer documents are taken
ASKED = 512  # queries counted at once
WEIGHTS = np.cumsum([0, *1.0 / np.arange(1, 8) ** 2])  # of a term by how often it is found
SPELT_TERMS = 100_000  # surface terms looked up in a task; of more, documents are stemmed by a join


def saturated(count: Column) -> Column:
    """``1 + 1/4 + ... + 1/count^2``: repeats add less and less."""
    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), count), F.lit(0.0), lambda acc, j: acc + 1.0 / (j * j))


def postings(documents: DataFrame, vocabulary: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(id, term, tf, ...)`` from ``id, terms``: an inverted index, optionally only for ``vocabulary``.

    The vocabulary filter runs on the exploded terms before anything is shuffled. Rows are then placed by
    document, so this grouping and any later one that includes ``id`` reuse the same shuffle.
    """
    terms = documents.select("id", *extra, F.explode("terms").alias("term"))
    if vocabulary is not None:
        terms = terms.join(vocabulary, "term", "left_semi")
    return terms.repartition("id").groupBy("id", *extra, "term").agg(F.count("*").alias("tf"))


def lexical_matches(queries: DataFrame, documents: DataFrame, *, scope: bool = False,
                    stems: DataFrame | None = None) -> DataFrame:
    """``(query_id, id, lexical_rank)`` for every document sharing a term with the query.

    ``queries`` has ``query_id, terms[, scope]``, ``documents`` has ``id, terms[, scope]``. ``stems``
    (``term, stem``) makes both sides meet on stems.
    """
    query_terms = queries.select("query_id", *(["scope"] if scope else []),
                                 F.explode(F.array_distinct("terms")).alias("term"))
    if stems is not None:
        query_terms = _stemmed(query_terms, stems).distinct()
        corpus = _stemmed(documents.select("id", *(["scope"] if scope else []), F.explode("terms").alias("term")), stems)
        corpus = corpus.join(query_terms.select("term").distinct(), "term", "left_semi")
        extra = ["scope"] if scope else []
        found = corpus.repartition("id").groupBy("id", *extra, "term").agg(F.count("*").alias("tf"))
    else:
        found = postings(documents, query_terms.select("term").distinct(), ("scope",) if scope else ())
    sizes = query_terms.groupBy("query_id").agg(F.count("*").alias("query_size"))
    wanted = query_terms.join(sizes, "query_id")
    if scope:
        wanted = wanted.withColumnRenamed("scope", "query_scope")
    pairs = found.withColumn("weight", saturated(F.col("tf"))).join(wanted, "term")
    if scope:
        pairs = pairs.where(F.col("query_scope").isNull() | (F.col("query_scope") == F.col("scope")))
    return (pairs.groupBy("query_id", "id")
            .agg((F.sum("weight") * _FULL / F.first("query_size")).alias("lexical_rank"))
            .withColumn("lexical_rank", F.round("lexical_rank", 4)))


def _stemmed(terms: DataFrame, stems: DataFrame) -> DataFrame:
    return terms.join(stems, "term", "left").withColumn("term", F.coalesce("stem", "term")).drop("stem")


def stemmed_queries(queries: DataFrame, stems: DataFrame) -> DataFrame:
    """``queries`` (``query_id, terms[, scope]``) with the distinct stems of their terms. Of ``stems`` only their own terms are joined."""
    terms = queries.select(*[c for c in queries.columns if c != "terms"], F.explode("terms").alias("term"))
    known = stems.join(written_stems(terms.select("term").distinct()), "term", "left_semi")
    kept = [c for c in terms.columns if c != "term"]
    return _stemmed(terms, known).groupBy(*kept).agg(F.collect_set("term").alias("terms"))


def lexical_top_k(queries: DataFrame, documents: DataFrame, k: int, *, scope: bool = False,
                  stems: DataFrame | None = None, stored: bool = False, broadcast_terms: int = BROADCAST_TERMS,
                  broadcast_queries: int = BROADCAST_QUERIES, spelt_terms: int = SPELT_TERMS) -> DataFrame:
    """The ``k`` best matches per query (ties to the smaller id), with ``rank``.

    Inputs as for ``lexical_matches``; ``stems`` may repeat rows, and is written first unless it is ``stored`` already. ``broadcast_terms`` and
    ``broadcast_queries`` bound what is broadcast at a time, ``spelt_terms`` how many surface terms a task looks up.
    """
    extra = ["scope"] if scope else []
    documents = documents.select("id", "terms", *extra)
    if stems is not None:
        stems = stems if stored else written_stems(stems)  # read several times below: made once
        asked = stemmed_queries(queries.select("query_id", "terms", *extra), stems)
        run = lambda part: _stem_matches(part, documents, k, scope, stems, spelt_terms)
    else:
        asked = queries.select("query_id", F.array_distinct("terms").alias("terms"), *extra)
        run = lambda part: _matches(part, documents, k, scope)
    size = asked.agg(F.sum(F.size("terms")).alias("n"), F.count("*").alias("q")).first()
    passes = max(-(-(size["n"] or 0) // max(broadcast_terms, 1)), -(-size["q"] // broadcast_queries), 1)
    matches = run(asked) if passes == 1 else in_passes(asked, passes, run, "lexical")
    return top_k(matches, ["query_id"], [F.desc("lexical_rank"), F.asc("id")], k)


def written_stems(table: DataFrame) -> DataFrame:
    path = run_folder(table.sparkSession, "stems")
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def _stem_matches(asked: DataFrame, documents: DataFrame, k: int, scope: bool, stems: DataFrame, spelt_terms: int) -> DataFrame:
    """Query stems are spelt out as the surface terms that share them; documents are scanned as they are.

    The spelling grows with the vocabulary, and a task would look up every batch in all of it. Above ``spelt_terms`` it is joined to the
    documents' terms instead, and what is scanned are their stems.
    """
    # written, so that its size is known and the dictionary is only scanned past it, never shuffled
    wanted = written_stems(asked.select(F.explode("terms").alias("stem")).distinct())
    spelt = stems.join(wanted, "stem", "left_semi").select("term", "stem")
    # a word the dictionary doesn't know is its own stem
    held = stems.select(F.col("term").alias("stem")).join(wanted, "stem", "left_semi")
    alone = wanted.join(held, "stem", "left_anti").select(F.col("stem").alias("term"), "stem")
    spelling = written_stems(spelt.union(alone).distinct())
    if spelling.count() <= spelt_terms:
        return _matches(asked, documents, k, scope, spelling)
    extra = ["scope"] if scope else []
    # ids may repeat: rows are numbered, and the numbers written, before they are taken apart
    rows = written_stems(documents.withColumn("row", F.monotonically_increasing_id()))
    found = rows.select("row", "id", *extra, F.explode("terms").alias("term")).join(spelling, "term")
    stemmed = found.groupBy("row", "id", *extra).agg(F.collect_list("stem").alias("terms"))
    return _matches(asked, stemmed.select("id", "terms", *extra), k, scope)


def _matches(asked: DataFrame, documents: DataFrame, k: int, scope: bool, spelling: DataFrame | None = None) -> DataFrame:
    table = asked.toArrow()  # counted: a bounded part of the queries
    if not table.num_rows:
        return documents.sparkSession.createDataFrame([], "query_id long, id long, lexical_rank double")
    index = _query_index(table, scope)
    if spelling is not None:
        spelt = spelling.toArrow()
        index["group"] = pc.index_in(spelt.column("stem"), value_set=index["vocabulary"]).to_numpy()
        index["vocabulary"] = spelt.column("term").combine_chunks().cast(pa.string())
    return scan(documents, _start, documents.sparkSession.sparkContext.broadcast(index), k, "lexical_rank")


def _start(index: dict, k: int):
    size = np.diff(index["own"])
    order = np.argsort(size, kind="stable")
    size, blocks = size[order], []
    first = int(np.searchsorted(size, 1))  # without terms nothing is found
    while first < len(order):  # queries of like numbers of terms are counted together
        last = min(first + ASKED, int(np.searchsorted(size, max(16, 2 * size[first]), side="right")))
        blocks.append(_Block(index, order[first:last], k))
        first = last

    def offer(batch: pa.RecordBatch) -> None:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(batch.column("terms")).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(ids):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + SLAB_ROWS, int(np.searchsorted(ends, base + SLAB_TERMS, side="right"))))
            entries = _weights(batch.column("terms").slice(start, stop - start), index)
            scopes = _scope_codes(batch.column("scope").slice(start, stop - start), index) if index["scopes"] is not None else None
            for slab in _slabs(entries, ids[start:stop], scopes, index):
                for block in blocks:
                    block.offer(slab)
            start = stop

    return [block.best for block in blocks], offer


def _slabs(entries: tuple, ids: np.ndarray, scopes: np.ndarray | None, index: dict):
    """Documents with some of the queries' terms, as few at a time as their bits ask for."""
    document, term, weight = entries
    if not len(term):
        return
    size = np.count_nonzero(np.bincount(term)) * len(ids) // 8
    step = max(64, -(-len(ids) // -(-size // SLAB_BYTES))) if size else len(ids)
    for start in range(0, len(ids), step):
        here = slice(*np.searchsorted(document, [start, start + step]))
        if here.stop > here.start:
            own = scopes[start:start + step] if scopes is not None else None
            yield _Slab(document[here] - start, term[here], weight[here], ids[start:start + step], own, index)


def _query_index(table: pa.Table, scope: bool) -> dict:
    """The queries' terms as numbers: those of the query at place ``q`` are ``term[own[q]:own[q + 1]]``."""
    lists = table.column("terms").combine_chunks()
    owner = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    coded = pc.dictionary_encode(lists.flatten())
    term = coded.indices.to_numpy(zero_copy_only=False)
    scopes = pc.dictionary_encode(table.column("scope").combine_chunks()) if scope else None
    return {
        "ids": table.column("query_id").to_numpy(), "vocabulary": coded.dictionary.cast(pa.string()), "terms": len(coded.dictionary),
        "term": term.astype("int32"), "own": np.searchsorted(owner, np.arange(table.num_rows + 1)),
        "weight": _FULL / np.maximum(np.bincount(owner, minlength=table.num_rows), 1),
        "scopes": scopes.indices.fill_null(-1).to_numpy(zero_copy_only=False) if scope else None,
        "scope_names": scopes.dictionary if scope else None}


def _scope_codes(column: pa.Array, index: dict) -> np.ndarray:
    """The scopes' numbers among the queries', -2 for others."""
    return pc.index_in(column, value_set=index["scope_names"], skip_nulls=True).fill_null(-2).to_numpy(zero_copy_only=False)


def _weights(lists: pa.Array, index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, term, weight)`` of the queries' terms in some documents, by document."""
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    code = pc.index_in(lists.flatten(), value_set=index["vocabulary"]).fill_null(-1).to_numpy(zero_copy_only=False)
    known = code >= 0
    held = code[known].astype("int64")
    held = index["group"][held] if "group" in index else held  # surface terms of one stem count together
    pair, tf = np.unique(owner[known] * index["terms"] + held, return_counts=True)
    weight = np.cumsum(1.0 / np.arange(1, (tf.max() if len(tf) else 0) + 1) ** 2)[tf - 1]
    return *np.divmod(pair, index["terms"]), weight


class _Slab:
    """Some documents as bits. A term counts as many quarters as its weight has, rounded up: 4, 5, 6 or 7 where it is found once, twice, three
    times or seven times and more. Row ``rows[p][t]`` of ``bits`` is bit ``2 - p`` of that number for term ``t``.
    """

    def __init__(self, document: np.ndarray, term: np.ndarray, weight: np.ndarray, ids: np.ndarray, scopes: np.ndarray | None, index: dict):
        self.ids, self.terms, self.words = ids, index["terms"], -(-len(ids) // 64)
        self.rows, places, count = [], [], 1  # row 0 is empty, for terms that no document holds
        twice, thrice, seven = (weight > WEIGHTS[often] - 1e-9 for often in (2, 3, 7))
        for held in (np.arange(len(term)), np.flatnonzero(thrice), np.flatnonzero(twice & ~thrice | seven)):
            present = np.flatnonzero(np.bincount(term[held], minlength=self.terms))
            row = np.zeros(self.terms + 1, "int64")  # one more for places without a term
            row[present] = np.arange(count, count + len(present))
            places.append((row[term[held]] * self.words + (document[held] >> 6), document[held] & 63))
            self.rows.append(row)
            count += len(present)
        self.key, self.weight = document[thrice] * self.terms + term[thrice], weight[thrice]  # in this order
        bits = np.zeros(count * self.words, "uint64")
        for word, bit in places:
            np.add.at(bits, word, np.uint64(1) << bit.astype("uint64"))
        self.bits = bits.reshape(count, self.words)
        if scopes is not None:  # bits of the documents that a scope sees; the last scope sees all
            known = np.flatnonzero(scopes >= 0)
            present, own = np.unique(scopes[known], return_inverse=True)
            flags = np.zeros((len(present) + 2, self.words * 64), bool)
            flags[own, known] = True
            flags[-1] = True
            self.seen = np.packbits(flags, axis=1, bitorder="little").view("uint64")
            self.scope = np.full(len(index["scope_names"]) + 1, len(present))  # the row before the last is empty
            self.scope[present], self.scope[-1] = np.arange(len(present)), len(present) + 1


class _Block:
    """Some queries, those at the places ``who``, and what they have found.

    For every query and document the weights of the terms they share are added up in quarters, rounded up: one bit of 64 documents' sums
    lies in a word, and adders made of logical operations take the words of one term after the other. Only documents whose sum may reach
    the query's best so far are ranked, term by term.
    """

    def __init__(self, index: dict, who: np.ndarray, k: int):
        self.best, self.share = BestPerQuery(index["ids"][who], k, LEAST), index["weight"][who]
        self.scopes = index["scopes"][who] if index["scopes"] is not None else None
        first, size = index["own"][who], index["own"][who + 1] - index["own"][who]
        place = np.arange(size.max())
        self.term = np.full((len(who), len(place)), index["terms"], "int32")
        held = place < size[:, None]
        self.term[held] = index["term"][(first[:, None] + place)[held]]
        self.depth, self.begun = int(7 * len(place)).bit_length(), False

    def offer(self, slab: _Slab) -> None:
        sums = self._sums(slab)
        seen = slab.seen[slab.scope[self.scopes]] if self.scopes is not None else None
        taken = None
        if not self.begun:  # a first floor from the documents with the largest sums
            self.begun = True
            taken = self._reached(sums, self._first(sums, seen), seen)
            self._take(slab, taken)
        if self.best.waiting * 8 > self.best.k * len(self.share):
            self.best.settle()
        # a rank equal to the last one's needs a smaller id
        same = np.where(slab.ids.min() >= self.best.last, 0.5, -0.5)
        least = ((self.best.floor + same) / SCALE - LEAST) / self.share
        reached = self._reached(sums, np.ceil(np.clip(4 * least - 1e-6, 1, 1 << self.depth)).astype("int64"), seen)
        if taken is not None:
            reached &= ~taken
        self._take(slab, reached)

    def _sums(self, slab: _Slab) -> list[np.ndarray]:
        """The bits of the sums, lowest first: words ``(queries, documents / 64)``."""
        levels, spare = [[] for _ in range(self.depth + 8)], []
        for level, rows in zip((2, 1, 0), slab.rows):
            row = rows[self.term]
            row[:, ::-1].sort(axis=1)  # empty ones last
            for at in np.ascontiguousarray(row.T):
                if not at.any():
                    break
                room = spare.pop() if spare else np.empty((len(at), slab.words), "uint64")
                _add(levels, spare, level, slab.bits.take(at, axis=0, out=room, mode="clip"))
        for level in range(self.depth):
            if len(levels[level]) == 2:
                x, y = levels[level]
                both = x & y
                x ^= y
                levels[level] = [x]
                _add(levels, spare, level + 1, both)
            elif not levels[level]:
                levels[level] = [np.zeros((len(self.share), slab.words), "uint64")]
        return [word for word, in levels[:self.depth]]

    def _reached(self, sums: list[np.ndarray], least: np.ndarray, seen: np.ndarray | None) -> np.ndarray:
        """Bits of the documents whose sum is at least ``least``, a number for each query."""
        found = np.full(sums[0].shape, ~np.uint64(0))
        for level, word in enumerate(sums):
            zero = np.where(least >> level & 1, np.uint64(0), ~np.uint64(0))[:, None]
            either = word | found
            either &= zero
            found &= word
            found |= either
        found[least >> self.depth > 0] = 0
        if seen is not None:
            found &= seen
        return found

    def _first(self, sums: list[np.ndarray], seen: np.ndarray | None) -> np.ndarray:
        """The largest number that the sums of ``k`` documents reach, at least 1."""
        least = np.zeros(len(self.share), "int64")
        for level in reversed(range(self.depth)):
            tried = least | 1 << level
            enough = np.bitwise_count(self._reached(sums, tried, seen)).sum(axis=1, dtype="int64") >= self.best.k
            least = np.where(enough, tried, least)
        return np.maximum(least, 1)

    def _take(self, slab: _Slab, reached: np.ndarray) -> None:
        words = np.flatnonzero(reached)
        flat = reached.reshape(-1)
        for start in range(0, len(words), RESCORED):
            part = words[start:start + RESCORED]
            at, bit = np.nonzero(np.unpackbits(flat[part].view("uint8").reshape(-1, 8), axis=1, bitorder="little"))
            query, word = np.divmod(part[at], slab.words)
            document = word * 64 + bit
            step = max(1, CELLS // self.term.shape[1])
            for first in range(0, len(query), step):
                q, d = query[first:first + step], document[first:first + step]
                self.best.take(q, slab.ids[d], self._ranks(slab, q, d))

    def _ranks(self, slab: _Slab, query: np.ndarray, document: np.ndarray) -> np.ndarray:
        """The ranks of some pairs. Bits tell which terms a document holds, and which of them twice; more weight is looked up."""
        bits, terms = slab.bits.reshape(-1), self.term[query]
        word, bit = document >> 6, np.uint64(1) << (document & 63).astype("uint64")
        shared = np.flatnonzero(bits.take(slab.rows[0][terms] * slab.words + word[:, None]) & bit[:, None])
        pair, term, weight = shared // terms.shape[1], terms.reshape(-1)[shared], np.ones(len(shared))

        def held(plane: int) -> np.ndarray:
            return bits.take(slab.rows[plane][term] * slab.words + word[pair]) & bit[pair] > 0

        weight[held(2)] = WEIGHTS[2]
        often = np.flatnonzero(held(1))
        weight[often] = slab.weight[np.searchsorted(slab.key, document[pair[often]] * slab.terms + term[often])]
        return np.bincount(pair, weight, len(query)) * self.share[query]


def _add(levels: list[list[np.ndarray]], spare: list[np.ndarray], level: int, word: np.ndarray) -> None:
    """Add bits worth ``2^level``: a level keeps two words, of three it keeps the sum's bit and passes the carry on."""
    levels[level].append(word)
    while len(levels[level]) == 3:
        x, y, z = levels[level]
        one = np.bitwise_xor(x, y, out=spare.pop() if spare else None)
        x &= y
        np.bitwise_xor(one, z, out=y)
        one &= z
        x |= one
        levels[level] = [y]
        spare += [one, z]
        level += 1
        levels[level].append(x)
