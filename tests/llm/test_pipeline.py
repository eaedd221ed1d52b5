"""The pipeline against its stages done by brute force."""

import os
import random

import pytest

import corpus_pipeline
from baraza.llm import queries, unigram

from .helpers import documents
from .test_dedup import WORDS, brute_classes, brute_contained, near_corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(6)
    items = [(k, " ".join(draw.choice(WORDS) + str(draw.randint(0, 9)) for _ in range(30))) for k in range(5)]
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in near_corpus(3)]
    n = len(rows)
    rows += [(n + k, t) for k, (_, t, _) in enumerate(rows[:6])] + [(n + 10, None), (n + 11, ""), (n + 12, "12 34 !"), (n + 13, "12 34 !")]
    rows += [(n + 20 + k, "words before it " + items[k][1] + f" and after {k}", "en") for k in range(3)] + [(n + 30, "one two three four", "en")]
    path = str(tmp_path_factory.mktemp("sf"))
    documents(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, [r[:2] for r in rows], items


def test_stages_equal_brute_force(spark, folder):
    path, rows, items = folder
    if not os.path.exists(queries.tokenizer_file(queries.PIECES)):
        pytest.skip("no tokenizer file")
    got = corpus_pipeline.run(spark, path).collect()
    left = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    keep = {}
    for i, t in left:
        keep[t] = max(i, keep.get(t, i))
    left = [(i, t) for t, i in keep.items()]
    classes = brute_classes(left)
    left = [(i, t) for i, t in left if classes[i] == i]
    bad = {i for i, _ in brute_contained(left, items)}
    left = dict((i, t) for i, t in left if i not in bad)
    assert len(bad) == 3 and {r.doc_id: r.text for r in got} == left
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)


def test_stages_return_the_columns_of_documents(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "benchmark", "encode"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0


def test_double_array_holds_exactly_the_keys():
    keys = {b"a": 1, b"ab": 2, b"abc": 3, b"b": 4, bytes([255, 0]): 5, b"zebra": 6}
    trie = unigram.Trie(keys)
    for key in [*keys, b"abcd", b"z", b"c", bytes([255])]:
        state, ok = 0, True
        for c in key:
            state, found = trie.step(state, c)
            ok = ok and bool(found)
            if not ok:
                break
        assert (int(trie.number[state]) if ok else -1) == keys.get(key, -1)
