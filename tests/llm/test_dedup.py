"""Exact, near and substring dedup, and decontamination, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from baraza.llm import bagminhash, containment, recipes, relative_lz
from baraza.llm.components import components

from .helpers import LONG, ODD, documents

WORDS = "the of and in to is was on for with as by it at from be are this that or an".split()


def corpus(n, seed, share=0.5):
    """Texts that share passages, copies, and repeats within one text."""
    draw = random.Random(seed)
    passages = [[draw.choice(WORDS) for _ in range(draw.randint(8, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randint(0, 6)):
            words += draw.choice(passages) if draw.random() < share else [draw.choice(WORDS) + str(draw.randint(0, 50)) for _ in range(draw.randint(1, 40))]
        rows.append((i, " ".join(words)))
    return rows + [(n, "x " * 90), (n + 1, rows[0][1]), (n + 2, "ab cd " * 40)]


@pytest.mark.parametrize("sizes", [{}, {"least": 32, "mean": 64, "most": 256}, {"least": 32, "mean": 64, "most": 256, "digest_size": 1}])
def test_exact_groups(spark, sizes):
    rows = ODD + corpus(60, 1)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in recipes.exact_groups(documents(spark, rows), **sizes).collect())
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert got == want


def test_keep_exact_keeps_columns_and_one_row(spark):
    docs = documents(spark, ODD)
    kept = recipes.keep_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 2, 3, 5, 7, 8]
    assert recipes.keep_exact(docs.limit(0)).count() == 0


def test_chunks_follow_content():
    body = np.random.default_rng(3).integers(0, 255, 60_000).astype(np.uint8)
    moved = np.concatenate([np.arange(100, dtype=np.uint8), body])

    def parts(data):
        ends = next(recipes.chunk_ends(data, np.array([0, len(data)]), 256, 1024, 8192))
        return {data[a:b].tobytes() for a, b in zip([0, *ends], ends)}, ends

    a, ends = parts(body)
    b, _ = parts(moved)
    assert ends[-1] == len(body) and len(a & b) > 0.9 * len(a)


def brute_repeats(rows, window):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words = (t or "").encode().split()
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s:s + window])
            if seen.setdefault(key, (i, s)) < (i, s):
                gone.update(range(s, s + window))
        out[i] = (len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode())
    return out


@pytest.mark.parametrize("window,seed,n", [(20, 5, 80), (8, 3, 60), (5, 2, 50)])
def test_repeated_windows(spark, window, seed, n):
    rows = corpus(n, window)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in relative_lz.without_repeats(documents(spark, rows), window, seed).collect()}
    assert got == brute_repeats(rows, window)


def test_repeats_of_odd_rows(spark):
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in relative_lz.without_repeats(documents(spark, ODD)).collect()), key=str)
    inner = brute_repeats([(6, LONG)], 20)[6][1]
    want = [(None, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0), (5, 1, 0), (5, 1, 0), (6, 40_000, inner), (7, 40_000, 40_000), (None, 7, 0), (8, 5, 0)]
    assert got == sorted(want, key=str)
    assert relative_lz.without_repeats(documents(spark, [])).count() == 0


def test_rows_of_one_id_with_unlike_texts(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, passage), (1, passage), (1, "q " + passage), (2, passage)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in relative_lz.without_repeats(documents(spark, rows)).collect())
    assert got == [(1, 30, 0), (1, 30, 0), (1, 31, 30), (2, 30, 30)]


def test_factors_name_the_earliest_place(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "a b " + passage), (2, passage + " c"), (3, "d " + passage)]
    got = sorted(tuple(r) for r in relative_lz.factors(documents(spark, rows)).collect())
    assert got == [(2, 0, 60, 1, 2), (3, 1, 60, 1, 2)]


def bag(text):
    words = (text or "").lower().split()
    n = max(len(words) - 4, min(len(words), 1))
    return Counter(tuple(words[i:i + 5]) for i in range(n))


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def near_corpus(seed):
    draw = random.Random(seed)
    rows = []
    for family in range(8):
        base = [f"{draw.choice(WORDS)}{draw.randint(0, 300)}" for _ in range(draw.randint(40, 200))]
        if family == 0:
            base = base[:10] * 20
        for _ in range(draw.randint(1, 9)):
            own = base[:]
            for _ in range(draw.randint(0, max(1, len(base) // 25))):
                own[draw.randrange(len(own))] = f"z{draw.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    return rows


def brute_classes(rows, threshold=0.8):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {i: bag(t) for i, t in rows}
    for i in bags:
        for j in bags:
            if i < j and jaccard(bags[i], bags[j]) >= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in bags}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_classes(spark, seed):
    rows = near_corpus(seed)
    got = bagminhash.near_classes(documents(spark, rows)).collect()
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_classes_of_odd_rows(spark):
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in bagminhash.near_classes(documents(spark, ODD)).collect()), key=str)
    want = [(None, None, True)] * 2 + [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 4, False), (5, 4, False), (6, 6, True), (7, 6, False), (8, 8, True)]
    assert got == sorted(want, key=str)
    assert bagminhash.near_classes(documents(spark, [])).count() == 0


def edited(draw, words, n):
    own = words[:]
    for at in draw.sample(range(0, len(own) - 5, 5), n):
        own[at] = f"e{draw.randint(0, 10**9)}"
    return own


def test_near_copies_of_one_text_that_are_not_near_each_other(spark):
    draw = random.Random(3)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(204)]
    texts = [" ".join(edited(draw, base, 4)) for _ in range(240)]
    rows = list(enumerate(texts[:120] + [" ".join(base)] + texts[120:]))
    assert jaccard(bag(texts[0]), bag(texts[-1])) < 0.8 <= jaccard(bag(texts[0]), bag(" ".join(base)))
    got = {r.doc_id: r.class_id for r in bagminhash.near_classes(documents(spark, rows)).collect()}
    assert got == brute_classes(rows) and set(got.values()) == {0}


@pytest.mark.parametrize("block", [20, 512])
def test_near_pairs_far_from_every_hub(spark, block, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    draw = random.Random(4)
    base = [f"w{draw.randint(0, 10**6)}" for _ in range(204)]
    firsts = [edited(draw, base, 3) for _ in range(100)]
    rows = list(enumerate(" ".join(t) for t in firsts + [edited(draw, t, 3) for t in firsts]))
    got = {r.doc_id: r.class_id for r in bagminhash.near_classes(documents(spark, rows)).collect()}
    want = brute_classes(rows)
    assert len(set(want.values())) > 1 and got == want


def test_signature_agreement_is_weighted_jaccard():
    weights = np.array([1, 1, 3, 8, 2, 1, 5, 1])
    others = np.array([1, 4, 3, 2, 2, 0, 5, 7])
    shingle = np.arange(8, dtype=np.uint64) * np.uint64(77777777777)
    have = others > 0
    row = np.concatenate([np.zeros(8, np.int64), np.ones(have.sum(), np.int64)])
    made = bagminhash.signatures(2, row, np.concatenate([shingle, shingle[have]]), np.concatenate([weights, others[have]]), 4000)
    truth = np.minimum(weights, others).sum() / np.maximum(weights, others).sum()
    assert abs((made[0] == made[1]).mean() - truth) < 0.03


def test_similarity_matches_counts():
    import pyarrow as pa
    rows = [t for _, t in near_corpus(5)][:12]
    left, right = rows, rows[1:] + rows[:1]
    got = bagminhash.similarity(pa.array(left), pa.array(right))
    assert np.allclose(got, [jaccard(bag(a), bag(b)) for a, b in zip(left, right)])


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(7, i) for i in range(200, 260)]
    got = {r.id: r.class_id for r in components(spark.createDataFrame(chain + hub + [(300, 299), (299, 300)], "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(200, 260)} == {7} and got[300] == 299
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_contained(docs, items, threshold=0.8):
    def shingles(t, n):
        words = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        n = min(len(words), 5) if n is None else n
        return n, {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()

    out = {}
    for i, t in docs:
        for k, u in items:
            n, own = shingles(u, None)
            if own and i is not None and k is not None:
                share = len(own & shingles(t, n)[1]) / len(own)
                if share >= 0.8 - 1e-9:
                    out[i, k] = max(share, out.get((i, k), 0))
    return out


def test_contained_items(spark):
    draw = random.Random(4)
    docs = corpus(40, 9) + ODD
    items = [(k, " ".join(draw.choice(WORDS) for _ in range(draw.randint(3, 60)))) for k in range(25)] + [(None, "a b c d e f"), (90, None), (91, ""), (92, "A, b c d; e!")]
    items += [(93, "what is love"), (94, "LOVE"), (95, "is love what"), (96, "the"), (97, "is what"), (97, "tell me what is love please now then"), (98, "...")]
    docs = docs + [(2000, "tell me what is love please now"), (2001, "what is")]
    for k in range(0, 25, 3):
        words = items[k][1].split()
        if len(words) > 10:
            words[draw.randrange(len(words))] = "changed"
        docs.append((1000 + k, " ".join(draw.choice(WORDS) for _ in range(80)) + " " + " ".join(words).upper() + ". end"))
    found = containment.contained(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_contained(docs, items)
    assert {(r.doc_id, r.item_id): r.containment for r in found.collect()} == want and {(2000, 93), (2000, 94)} <= set(want)


def test_contained_in_empty_tables(spark):
    docs, items = documents(spark, ODD), spark.createDataFrame([], "item_id long, text string")
    assert containment.contained(docs, items).count() == 0
    assert containment.contained(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert containment.without_items(docs, items).count() == len(ODD)


def test_documents_are_split_once(spark):
    """A filter on the number of words, and functions over them, do not split a text again."""
    docs = containment._split(documents(spark, [(1, "a b c"), (2, None), (3, " ,, ")]), "doc_id").where("size(w) > 2 OR size(w) = 0")
    plan = docs.withColumn("n", F.size("w"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1
    assert sorted((r.doc_id, r.w) for r in docs.collect()) == [(1, ["a", "b", "c"]), (2, []), (3, [])]
