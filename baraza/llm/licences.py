"""Licence scan with a positional index of rare template words.

Licence templates are indexed by their rarest words: document frequencies of all template words are counted over the whole
table, and each template is looked up by its ``rare`` words of the highest inverse document frequency. Where such a word
stands in a file, its postings say where the template would have to begin; words that agree on a beginning meet there. The
template is taken if its mandatory key phrase stands whole at its place and the words that agree carry ``least`` or more of
the template's weight. Everything is done in expressions on a row; only the word counts are shuffled, after a partial sum.

* A null or empty text has no words: counts 0, empty labels, score 0, no places.
* The score is the largest share of a template's weight that was found, at least a half where a base phrase stands.
* Null ids and repeated rows are rows like any other; columns besides ``doc_id`` and ``text`` are ignored; an empty table
  gives an empty result.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baraza.llm.text import places, split_words

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        key = self.key.split()
        return next(i for i in range(len(self.words)) if self.words[i:i + len(key)] == key)


TEMPLATES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("mit", "released under the mit license", "mit license"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl", "licensed under the gnu general public license version 3", "general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4"),
    Template("cc-by", "creative commons attribution 4 0 international", "creative commons attribution 4"),
]


def words_of(text: Column) -> Column:
    return split_words(F.translate(text, _UPPER, _LOWER), BETWEEN)


def inverse_frequencies(docs: DataFrame, templates: list[Template] = TEMPLATES) -> dict[str, float]:
    """The weight of every template word over all documents; as many rows as the templates have words reach the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = docs.select(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary))).alias("w"))
    counted = held.select(F.explode(F.concat("w", F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in counted}
    many = found.pop("", 0)
    return {w: math.log((many + 1) / (found.get(w, 0) + 1)) + 1 for w in vocabulary}


def _base_places(words: Column) -> Column:
    """``label, at`` of the base phrases, found at their last word."""
    ends = {p.split()[-1] for p in BASE}
    at = F.filter(places(F.size(words)), lambda i: F.get(words, i).isin(*ends))

    def matches(i):
        found = []
        for phrase, label in BASE.items():
            own = phrase.split()
            first = i - len(own) + 1
            whole = F.lit(True)
            for d, w in enumerate(own):
                whole = whole & F.coalesce(F.get(words, first + d) == w, F.lit(False))
            found.append(F.when(whole, F.struct(F.lit(label).alias("label"), first.alias("at"))))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    any_ = F.arrays_overlap(words, F.array(*map(F.lit, sorted(ends))))
    return F.when(any_, F.flatten(F.transform(at, matches))).otherwise(F.array().cast("array<struct<label: string, at: int>>"))


def _array(values, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def _index(templates: list[Template], weights: dict[str, float], rare: int) -> list[tuple[str, int, int]]:
    """``word, template, place`` of each template's rarest words."""
    index = []
    for number, t in enumerate(templates):
        chosen = sorted(set(t.words), key=lambda w: (-weights[w], w))[:rare]
        index += [(w, number, at) for at, w in enumerate(t.words) if w in chosen]
    return index


def _matches(words: Column, found: Column, index: list[tuple[str, int, int]], templates: list[Template], weights: dict[str, float], least: float) -> Column:
    """``label, share`` of the templates that stand in the file; ``found``: the index words that it holds."""
    postings = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k"), F.lit(q).alias("q")) for w, k, q in index])
    held = F.array(*[F.struct(F.lit(t.label).alias("label"), _array(t.words, "string").alias("words"), _array([weights[w] for w in t.words], "double").alias("weights"),
                              F.lit(sum(weights[w] for w in t.words)).alias("whole"), F.lit(t.key_at).alias("key_at"), _array(t.key.split(), "string").alias("key"))
                     for t in templates])
    at = F.filter(places(F.size(words)), lambda i: F.array_contains(found, F.get(words, i)))
    begins = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(
        F.filter(postings, lambda e: e["w"] == F.get(words, i)), lambda e: F.struct(e["k"].alias("k"), (i - e["q"]).alias("at"))))))

    def judged(b):
        t = F.get(held, b["k"])
        first = b["at"] + t["key_at"]
        key = F.forall(places(F.size(t["key"])), lambda j: F.coalesce(F.get(words, first + j) == F.get(t["key"], j), F.lit(False)))
        share = F.aggregate(places(F.size(t["words"])), F.lit(0.0), lambda s, j: s + F.when(
            F.get(words, b["at"] + j) == F.get(t["words"], j), F.get(t["weights"], j)).otherwise(0.0))
        return F.struct(t["label"].alias("label"), F.when(key, F.round(F.least(share / t["whole"], F.lit(1.0)), 9)).otherwise(0.0).alias("share"))

    none = F.array().cast("array<struct<label: string, share: double>>")
    return F.when(F.size(found) > 0, F.filter(F.transform(begins, judged), lambda m: m["share"] >= least)).otherwise(none)


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, rare: int = 3, least: float = 0.5) -> DataFrame:
    """``doc_id, n_words, base, matches``: places of base phrases and templates that stand in each file."""
    weights = inverse_frequencies(docs, templates)
    index = _index(templates, weights, rare)
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    # a column of its own: inside a function over words it would be found again for each word
    found = words.withColumn("found", F.array_intersect("words", _array(sorted({w for w, _, _ in index}), "string")))
    return found.select("doc_id", F.size("words").cast("long").alias("n_words"), _base_places(F.col("words")).alias("base"),
                        _matches(F.col("words"), F.col("found"), index, templates, weights, least).alias("matches"))


def licences(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every document."""
    label = lambda column: F.transform(column, lambda x: x["label"])
    at = F.transform("base", lambda x: x["at"].cast("long"))
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return scan(docs, **options).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        listed(label("base")).alias("base_labels"), listed(F.concat(label("base"), label("matches"))).alias("labels"),
        F.greatest(best, F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"))
