import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from baraza.operators import chain, fusion, geometry, grouped, guards, knn, lexical, ordered


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = [(k, i, rnd.choice([None, "a", "b", "c"]), rnd.randint(0, 9)) for i in range(400) for k in [rnd.randint(0, 2)]]
    data += [(9, i, None, 1) for i in range(1000, 1003)]
    return data, spark.createDataFrame(data, "k int, i long, v string, n int")


def _by_key(data):
    groups = {}
    for row in sorted(data, key=lambda r: r[1]):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_blocked_windows_match_model(rows, block):
    data, df = rows
    got = {r["i"]: r for r in ordered.forward_fill(df, ["k"], "i", {"incl": F.col("v")}, block=block).collect()}
    prev = {r["i"]: r["out"] for r in ordered.forward_fill(df, ["k"], "i", {"out": F.col("v")}, inclusive=False, block=block).collect()}
    total = {r["i"]: r["s"] for r in ordered.running_sum(df, ["k"], "i", F.col("n"), "s", block=block).collect()}
    lagged = {r["i"]: r["p"] for r in ordered.previous_row(df, ["k"], "i", F.col("v"), "p", block=block).collect()}
    history = {r["i"]: r["h"] for r in ordered.previous_rows(df, ["k"], "i", F.col("n"), "h", 6, block=block).collect()}
    assert len(got) == len(data)
    for group in _by_key(data).values():
        last, running, seen = None, 0, []
        for j, (_, i, v, n) in enumerate(group):
            assert prev[i] == last
            last = v if v is not None else last
            assert got[i]["incl"] == last
            running += n
            assert total[i] == running
            assert lagged[i] == (group[j - 1][2] if j else None)
            assert history[i] == seen[-6:]
            seen.append(n)


def _knn_model(q, qs, v, vs, k, same=False):
    out = {}
    for a, x in enumerate(q):
        hits = [(-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 4), b) for b, y in enumerate(v)
                if (qs is None or qs[a] is None or qs[a] == vs[b]) and not (same and a == b)]
        out[a] = [(b, -s) for s, b in sorted(hits)[:k]]
    return out


@pytest.mark.parametrize("passes", [False, True])
@pytest.mark.parametrize("scope", [False, True])
def test_nearest(spark, passes, scope):
    rng = np.random.default_rng(3)
    q, v = rng.integers(-2, 3, (7, 4)) + 0.25, rng.integers(-2, 3, (60, 4)) + 0.5
    qs = ["x", "y", None, "x", "z", "y", "x"] if scope else None
    vs = [("x", "y")[i % 2] for i in range(60)] if scope else None
    queries = spark.createDataFrame([(i, q[i].tolist(), qs[i] if scope else None) for i in range(7)], "query_id long, vector array<double>, scope string")
    vectors = spark.createDataFrame([(i, v[i].tolist(), vs[i] if scope else None) for i in range(60)], "id long, vector array<double>, scope string")
    small = dict(broadcast_bytes=100) if passes else {}
    found = knn.nearest(queries, vectors, 5, scope=scope, **small).orderBy("query_id", "rank").collect()
    got = {i: [] for i in range(7)}
    for r in found:
        got[r["query_id"]].append((r["id"], r["similarity"]))
    assert got == _knn_model(q, qs, v, vs, 5)


def test_scopes_reach_the_scan(spark, tmp_path):
    """Only scopes that a query sees are read; an unknown scope finds nothing, a null one on the vectors' side only open queries."""
    spark.createDataFrame([(i, [1.0, float(i)], s) for i, s in enumerate(["x", "y", None, "z", "x"])], "id long, vector array<double>, scope string").write.parquet(str(tmp_path / "v"))
    vectors = spark.read.parquet(str(tmp_path / "v"))
    asked = spark.createDataFrame([(1, [1.0, 4.0], "x"), (2, [1.0, 0.0], "none"), (3, [1.0, 1.0], "z")], "query_id long, vector array<double>, scope string")
    found = knn.nearest(asked, vectors, 5, scope=True)
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(1, 0), (1, 4), (3, 3)]
    assert "PushedFilters: [IsNotNull(vector), In(scope, [none,x,z])]" in found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    open_ = spark.createDataFrame([(9, [1.0, 4.0], None)], "query_id long, vector array<double>, scope string")
    assert sorted(r.id for r in knn.nearest(open_, vectors, 9, scope=True).collect()) == [0, 1, 2, 3, 4]


def test_nearest_edges(spark):
    one_hot = [(i, [1.0 if j == i else 0.0 for j in range(3)]) for i in range(3)]
    vectors = spark.createDataFrame(one_hot, "id long, vector array<double>")
    queries = spark.createDataFrame([(1, one_hot[1][1])], "query_id long, vector array<double>")
    assert [(r["id"], r["similarity"]) for r in knn.nearest(queries, vectors, 2).collect()][0] == (1, 1.0)
    assert knn.nearest(queries, vectors, 99).count() == 3
    assert knn.nearest(queries, vectors.limit(0), 5).count() == 0
    assert knn.nearest(queries.limit(0), vectors, 5).count() == 0


@pytest.mark.parametrize("scope", [False, True])
def test_lexical_paths_agree(spark, scope):
    rnd = random.Random(1)
    words = [f"t{i}" for i in range(12)]
    docs = [(i, [rnd.choice(words) for _ in range(rnd.randint(0, 30))], rnd.choice("xy")) for i in range(80)]
    asked = [(i, [rnd.choice(words + ["zz"]) for _ in range(rnd.randint(0, 5))], rnd.choice(["x", "y", None])) for i in range(15)]
    d = spark.createDataFrame(docs, "id long, terms array<string>, scope string")
    q = spark.createDataFrame(asked, "query_id long, terms array<string>, scope string")
    streamed = lexical.lexical_top_k(q, d, 4, scope=scope).collect()
    gridded = lexical.lexical_top_k(q, d, 4, scope=scope, broadcast_terms=9).collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, lexical.lexical_top_k(q, d, 4, scope=scope, broadcast_queries=4).collect()))
    matched = {(r["query_id"], r["id"]): r["lexical_rank"] for r in lexical.lexical_matches(q, d, scope=scope).collect()}
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, gridded))
    assert all(matched[(r["query_id"], r["id"])] == r["lexical_rank"] for r in streamed)
    full = 6 / np.pi ** 2
    for query_id, terms, sc in asked:
        want = []
        for i, dt, ds in docs:
            if scope and sc is not None and sc != ds:
                continue
            s = sum(sum(1 / j ** 2 for j in range(1, dt.count(t) + 1)) for t in set(terms)) * full / max(len(set(terms)), 1)
            if s > 0:
                want.append((-round(s, 4), i))
        got = sorted((r["rank"], r["id"], r["lexical_rank"]) for r in streamed if r["query_id"] == query_id)
        assert [(i, s) for _, i, s in got] == [(i, -s) for s, i in sorted(want)[:4]]


def test_stemmed_matches(spark):
    from baraza.functions.stemming import porter, stem_dictionary

    assert [porter(w) for w in ("stalled", "stalling", "relational", "hopping", "ponies", "agreed", "happy", "adjustable", "controlling", "sky")] == [
        "stall", "stall", "relat", "hop", "poni", "agre", "happi", "adjust", "control", "sky"]
    d = spark.createDataFrame([(1, ["stalled", "works"]), (2, ["road"])], "id long, terms array<string>")
    q = spark.createDataFrame([(1, ["stall"])], "query_id long, terms array<string>")
    stems = stem_dictionary(d.select(F.explode("terms").alias("term")).union(q.select(F.explode("terms"))))
    assert [r["id"] for r in lexical.lexical_top_k(q, d, 5, stems=stems).collect()] == [1]
    assert lexical.lexical_top_k(q, d, 5).count() == 0


def test_stems_in_passes(spark):
    """Stems found in several passes, against all matches by joins."""
    rnd = random.Random(2)
    words = [f"{w}{e}" for w in ("road", "stall", "work", "fund") for e in ("", "s", "ed", "ing")]
    d = spark.createDataFrame([(i, [rnd.choice(words) for _ in range(rnd.randint(0, 9))]) for i in range(60)], "id long, terms array<string>")
    q = spark.createDataFrame([(i, [rnd.choice(words + ["unknown"]) for _ in range(rnd.randint(1, 3))]) for i in range(12)], "query_id long, terms array<string>")
    stems = spark.createDataFrame([(w, w.removesuffix("s").removesuffix("ed").removesuffix("ing")) for w in words], "term string, stem string")
    every = {}
    for r in lexical.lexical_matches(q, d, stems=stems).collect():
        every.setdefault(r.query_id, []).append((-r.lexical_rank, r.id))
    want = sorted((i, b, -a) for i, hits in every.items() for a, b in sorted(hits)[:4])
    for options in ({}, {"broadcast_terms": 5}):
        assert sorted((r.query_id, r.id, r.lexical_rank) for r in lexical.lexical_top_k(q, d, 4, stems=stems, **options).collect()) == want


def test_fusion(spark):
    near = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 2, 0.8)], "query_id long, id long, rank int, similarity double")
    words = spark.createDataFrame([(1, 2, 1, 0.5), (1, 3, 2, 0.4)], "query_id long, id long, rank int, lexical_rank double")
    got = fusion.reciprocal_rank_fusion([near, words], 5).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 1, 3]
    assert got[0]["similarity"] == 0.8 and got[0]["lexical_rank"] == 0.5


def test_weak(spark):
    queries = spark.createDataFrame([(i,) for i in range(1, 5)], "query_id long")
    hits = spark.createDataFrame([(2, 0.1, None), (3, 0.5, None), (4, 0.0, 0.02)], "query_id long, similarity double, lexical_rank double")
    weak = {r["query_id"]: r["weak"] for r in fusion.weak_retrieval(queries, hits).collect()}
    assert weak == {1: True, 2: True, 3: False, 4: False}


def test_best_variant(spark):
    hits = spark.createDataFrame([(1, 7, 0.2), (1, 7, 0.8), (1, 5, 0.8), (1, 6, 0.3)], "query_id long, id long, similarity double")
    got = fusion.best_per_variant(hits, 2).orderBy("rank").collect()
    assert [(r["id"], r["similarity"]) for r in got] == [(5, 0.8), (7, 0.8)]


def test_zero_fill(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "s string")
    got = {r["s"]: r["cnt"] for r in grouped.zero_filled_counts(df, "s", ["a", "b", "c"]).collect()}
    assert got == {"a": 2, "b": 1, "c": 0}
    assert {r["s"]: r["cnt"] for r in grouped.zero_filled_counts(df.limit(0), "s", ["a"]).collect()} == {"a": 0}


def test_geometry(spark):
    shape = "source string, page int, x0 double, y0 double, x1 double, y1 double, seq long, text string"
    blocks = spark.createDataFrame([("s", 1, 0.0, 0.0, 10.0, 2.0, 1, " intro "), ("s", 1, 0.0, 10.0, 10.0, 12.0, 2, "cell"),
                                    ("s", 1, 0.0, 19.0, 10.0, 23.0, 3, "half in"), ("s", 1, 5.0, 30.0, 9.0, 31.0, 5, "right"),
                                    ("s", 1, 0.0, 30.0, 4.0, 31.0, 4, "left"), ("s", 2, 0.0, 10.0, 1.0, 11.0, 1, "other page")], shape)
    tables = spark.createDataFrame([("s", 1, 0.0, 9.0, 20.0, 20.0, 1, "|a<br>b|c<br/>d|")], shape)
    got = {r["page"]: r["text"] for r in geometry.page_text(blocks, tables).collect()}
    assert got == {1: "intro\n\n|a b|c d|\n\nhalf in\n\nleft\n\nright", 2: "other page"}


# ---- guards -----------------------------------------------------------------------------------
def _limiter_model(times, limit, window):
    hits, out = [], []
    for t in times:
        hits = [h for h in hits if h > t - window]
        if len(hits) < limit:
            hits.append(t)
            out.append((True, 0.0))
        else:
            out.append((False, float(hits[0] + window - t)))
    return out


def _events(spark, times):
    return spark.createDataFrame([(k, i, t) for k, ts in times.items() for i, t in enumerate(ts)], "k string, i long, t long").select(
        "k", "i", F.timestamp_seconds("t").alias("ts"))


def _limited(df):
    out = {}
    for r in df.orderBy("k", "i").collect():
        out.setdefault(r["k"], []).append((r["allowed"], r["retry_after"]))
    return out


def test_limiter_cases(spark):
    got = _limited(guards.rate_limit(_events(spark, {"a": [0, 1, 2, 3]}), ["k"], "ts", "i", limit=3, window_seconds=60))
    assert [a for a, _ in got["a"]] == [True, True, True, False] and got["a"][3][1] > 0
    got = _limited(guards.rate_limit(_events(spark, {"a": [0, 10], "b": [0, 5, 61]}), ["k"], "ts", "i", limit=1, window_seconds=60))
    assert got["a"][1] == (False, 50.0) and [a for a, _ in got["b"]] == [True, False, True]


@pytest.mark.parametrize("max_rows", [5_000_000, 25, 4])
def test_limiter_matches_model_when_cut(spark, max_rows):
    """Whole keys, quiet cuts and chained segments all give the sequential result."""
    rnd = random.Random(max_rows)
    times = {f"k{n}": sorted(rnd.randint(0, span) for _ in range(60)) for n, span in enumerate([50, 400, 3000, 20000])}
    got = _limited(guards.rate_limit(_events(spark, times), ["k"], "ts", "i", limit=3, window_seconds=30, max_rows=max_rows))
    assert got == {k: _limiter_model(ts, 3, 30) for k, ts in times.items()}


@pytest.mark.parametrize("ranges", [None, 5])
def test_paced_chains_match_the_scan(spark, ranges):
    """One event per pause by doubled pointers: ties, a flooding key, single rows, a null key."""
    rnd = random.Random(6)
    times = {"flood": sorted(rnd.randint(0, 300) for _ in range(300)), "same": [5] * 20, "one": [3], None: [0, 1, 10, 30], "rare": list(range(0, 3000, 70))}
    rows = spark.createDataFrame([(k, i, t) for k, ts in times.items() for i, t in enumerate(ts)], "k string, i long, t long")
    got = {}
    for r in chain.paced(rows, ["k"], "t", ["i"], 7, ranges=ranges).orderBy("k", "i").collect():
        got.setdefault(r.k, []).append((r.in_chain, None if r.last_time is None else r.last_time + 7 - r.t))
    want = {k: [(a, None if a else int(w)) for a, w in _limiter_model(ts, 1, 7)] for k, ts in times.items()}
    assert got == want


@pytest.mark.parametrize("max_rows", [5_000_000, 30])
def test_one_per_window_for_a_flooding_key(spark, max_rows):
    rnd = random.Random(9)
    times = {f"k{n}": sorted(rnd.randint(0, span) for _ in range(60)) for n, span in enumerate([50, 3000])} | {"few": [0, 1, 40]}
    got = _limited(guards.rate_limit(_events(spark, times), ["k"], "ts", "i", limit=1, window_seconds=30, max_rows=max_rows))
    assert got == {k: _limiter_model(ts, 1, 30) for k, ts in times.items()}


def test_free_islands_need_no_fold(spark):
    """Rows that cannot be blocked are told apart: an island with one crowded place goes to the fold as a whole."""
    times = {"free": [0, 10, 40, 50, 80, 90], "crowd": [0, 1, 2, 20, 200, 230], "edge": [0, 10, 30, 40]}
    got = guards.folded_share(_events(spark, times), ["k"], "ts", "i", limit=2, window_seconds=30).first()
    assert (got.events, got.folded) == (16, 4)


def test_guard_of_a_flooding_reporter(spark):
    """A reporter beyond a task who names every answer once is decided by pointers, others by the scan; the verdicts are the same."""
    rnd = random.Random(12)
    rows = [(100 + i, 1, t) for i, t in enumerate(sorted(rnd.randint(0, 5000) for _ in range(80)))]
    rows += [(rnd.choice([100, 101, 102]), u, rnd.randint(0, 5000)) for u in (2, 3) for _ in range(40)]
    rows.sort(key=lambda r: r[2])
    answers = spark.createDataFrame([(i, "assistant") for i in range(100, 200)], "id long, role string")
    reports = _reports(spark, rows)
    want = guards.report_guard(reports, answers, spacing_seconds=60).orderBy("id").collect()
    got = guards.report_guard(reports, answers, spacing_seconds=60, max_rows=30).orderBy("id").collect()
    assert got == want and [r["reason"] for r in got] == _guard_model(rows, 60)


def test_block_notices(spark):
    decided = guards.rate_limit(_events(spark, {"a": [0, 1, 2, 30, 65, 66]}), ["k"], "ts", "i", limit=1, window_seconds=60)
    got = [r["notify"] for r in guards.block_notices(decided, ["k"], "ts", "i", window_seconds=60).orderBy("i").collect()]
    assert got == [True, False, False, True]  # blocked at 1, 2, 30 and 66


def _messages(spark):
    return spark.createDataFrame([(10, "assistant"), (11, "assistant"), (12, "user"), (13, "assistant")], "id long, role string")


def _reports(spark, rows):
    return spark.createDataFrame([(i, m, u, t) for i, (m, u, t) in enumerate(rows)], "id long, message_id long, reported_by_user_id long, t long").select(
        "id", "message_id", "reported_by_user_id", F.timestamp_seconds("t").alias("created_at"))


def test_guard_cases(spark):
    reports = _reports(spark, [(10, 1, 0), (10, 1, 5), (11, 1, 10), (12, 1, 100), (99, 1, 101), (11, 1, 31)])
    got = guards.report_guard(reports, _messages(spark)).orderBy("id").collect()
    assert [r["reason"] for r in got] == ["created", "duplicate", "rate_limited", "not_an_answer", "message_not_found", "created"]
    assert got[0]["report_count"] == 1 and not got[0]["flagged_for_review"]
    assert got[1]["report_count"] == 1 and got[2]["retry_after"] == 20.0


def test_guard_diversity(spark):
    got = guards.report_guard(_reports(spark, [(10, 1, 0), (10, 2, 1), (10, 3, 2)]), _messages(spark)).orderBy("id").collect()
    assert [(r["report_count"], r["flagged_for_review"]) for r in got] == [(1, False), (2, False), (3, True)]


def _guard_model(rows, spacing):
    last, seen, out = {}, set(), []
    for m, u, t in rows:
        if (m, u) in seen:
            out.append("duplicate")
        elif u in last and t - last[u] < spacing:
            out.append("rate_limited")
        else:
            seen.add((m, u))
            last[u] = t
            out.append("created")
    return out


@pytest.mark.parametrize("max_rows", [5_000_000, 20])
def test_guard_matches_model_when_cut(spark, max_rows):
    rnd = random.Random(4)
    rows = sorted(((rnd.choice([10, 11, 13]), rnd.randint(1, 3), rnd.randint(0, 40_000)) for _ in range(150)), key=lambda r: r[2])
    got = guards.report_guard(_reports(spark, rows), _messages(spark), spacing_seconds=300, max_rows=max_rows).orderBy("id").collect()
    assert [r["reason"] for r in got] == _guard_model(rows, 300)


def test_guard_reply(spark):
    df = spark.createDataFrame([(False, False, "rate_limited", 12.7), (True, True, "created", None)], "c boolean, f boolean, r string, w double")
    got = [r[0] for r in df.select(guards.guard_reply(F.col("c"), F.col("f"), F.col("r"), F.col("w"))).collect()]
    assert got[0].startswith("Please wait 12 seconds") and "several people" in got[1]


@pytest.mark.parametrize("cells", [4 << 20, 64])
def test_best_per_query_with_early_floors(monkeypatch, cells):
    """Settling often (tiny ``cells``) must keep exactly what one final ranking keeps, ties included."""
    from baraza.operators import blocked

    monkeypatch.setattr(blocked, "CELLS", cells)
    rng = np.random.default_rng(9)
    scores, ids = rng.integers(0, 6, (5, 400)) / 10, rng.permutation(400)
    best = blocked.BestPerQuery(np.arange(100, 105), 4)
    for start in range(0, 400, 23):
        part = slice(start, start + 23)
        best.offer(scores[:, part], ids[part], scores[:, part] > 0)
    got = {}
    for r in best.frame("s").itertuples():
        got.setdefault(r.query_id, []).append((-r.s, r.id))
    assert {q: sorted(v) for q, v in got.items()} == {100 + q: sorted((-s, i) for s, i in zip(scores[q], ids) if s > 0)[:4] for q in range(5)}


def test_embedding_hook(spark):
    from baraza.functions.vectors import embed_in_batches, hashed_word_vectors

    df = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "i long, text string")
    sizes = spark.sparkContext.accumulator(0)

    def embed(texts):
        assert len(texts) <= 2
        sizes.add(len(texts))
        return [[3.0, 4.0] if t != "t0" else [0.0, 0.0] for t in texts]

    got = {r["i"]: r["v"] for r in embed_in_batches(df.coalesce(1), "text", "v", embed, batch_size=2).collect()}
    assert got[0] == [0.0, 0.0] and all(abs(got[i][0] - 0.6) < 1e-6 for i in range(1, 7)) and sizes.value == 7
    hashed = hashed_word_vectors(df.select(F.split("text", " ").alias("terms")), "terms", "v", 16).select("v").first()[0]
    assert len(hashed) == 16 and abs(sum(x * x for x in hashed) - 1) < 1e-6


def test_sketches_of_days_merge(spark):
    """A union over days equals one pass, counts small sets exactly and stays within 5 % of large ones."""
    made = spark.range(60_000).select((F.col("id") % 3).alias("message_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 21).otherwise(
        F.col("id") % 17_011).alias("reported_by_user_id"), F.timestamp_seconds(F.col("id") * 60).alias("created_at"))
    exact = {r.message_id: r.reporters for r in guards.distinct_reporters(made).collect()}
    daily = {r.message_id: r.reporters for r in guards.reporters_from_sketches(guards.reporter_sketches(made)).collect()}
    at_once = made.withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    once = {r.message_id: r.reporters for r in guards.reporters_from_sketches(guards.reporter_sketches(at_once)).collect()}
    assert daily == once and daily[0] == exact[0] == 7
    assert all(abs(daily[m] - n) <= 0.05 * n for m, n in exact.items()) and exact[1] > 10_000


def test_already_reported(spark):
    reports = _reports(spark, [(10, 1, 0)])
    asked = spark.createDataFrame([(10, 1), (10, 2)], "message_id long, reported_by_user_id long")
    assert [tuple(r) for r in guards.already_reported(reports, asked).collect()] == [(10, 1)]


def test_vectors_of_unlike_lengths_are_named(spark):
    own = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "id long, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    with pytest.raises(Exception, match="unlike lengths"):
        knn.nearest(asked, own, 1).collect()


def test_rough_scores_are_rescored():
    """Only pairs that a rough score lets near their query's floor are scored exactly, and the exact score decides."""
    from baraza.operators import blocked

    rng = np.random.default_rng(4)
    exact = np.round(rng.random((3, 2000)), 4)
    ids, best, asked = rng.permutation(2000), blocked.BestPerQuery(np.arange(3), 5), []
    for start in range(0, 2000, 250):
        here = slice(start, start + 250)
        rough = (exact[:, here] + rng.uniform(-1e-4, 1e-4, (3, 250))).astype("float32")

        def pairs(r, c, part=exact[:, here]):
            asked.append(len(r))
            return part[r, c]
        best.screen(rough, 2e-4, ids[here], pairs, lambda part=exact[:, here]: part)
    found = best.frame("s")
    assert sum(asked) < 200
    for q in range(3):
        own = found[found.query_id == q]
        assert sorted(zip(-own.s, own.id)) == sorted(zip(-exact[q], ids))[:5]


def test_search_batches_are_bounded(spark):
    """A worker is handed long rows in small batches, however many rows a partition holds."""
    from baraza.operators import blocked

    rows = spark.range(0, 3000, 1, 1).select("id", F.array_repeat(F.repeat(F.lit("x"), 100), 100).alias("terms"))
    shared = spark.sparkContext.broadcast(None)

    def start(_, k):
        sizes = blocked.BestPerQuery(np.arange(1), k)

        def offer(part):
            sizes.take(np.zeros(1, "int64"), np.array([part.column("id")[0].as_py()]), np.array([float(part.nbytes)]))
        return [sizes], offer

    assert max(r.s for r in blocked.scan(rows, start, shared, 1, "s").collect()) <= 2 * blocked.BATCH_BYTES


def test_passes_count_what_is_found(spark, monkeypatch):
    """Queries go in more passes where many rows are kept for each, so what a task holds stays bounded."""
    taken = []
    real = knn.in_passes
    monkeypatch.setattr(knn, "in_passes", lambda q, count, run, label: (taken.append(count), real(q, count, run, label))[1])
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "id long, vector array<double>")
    asked = rows.withColumnRenamed("id", "query_id")
    few, many = (knn.nearest(asked, rows, k, broadcast_bytes=20_000) for k in (2, 20))
    assert few.count() == 80 and many.count() == 800 and taken == [4]


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    from baraza.plans import retrieval

    searched = []
    real = retrieval.nearest
    monkeypatch.setattr(retrieval, "nearest", lambda q, *a, **k: (searched.append(q.count()), real(q, *a, **k))[1])
    chunks = spark.createDataFrame([(1, "road works", [1.0, 0.0]), (2, "water", [0.0, 1.0])], "id long, chunk_text string, embedding array<double>")
    asked = spark.createDataFrame([(7, "road"), (8, "ROAD"), (9, "tap")], "query_id long, text string")
    embed = lambda df: df.withColumn("vector", F.when(F.lower("text") == "road", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    hits = retrieval.hybrid_hits(asked, chunks, embed, 1, variants=False, lexical=False)
    assert sorted((r.query_id, r.id, r.similarity) for r in hits.collect()) == [(7, 1, 1.0), (8, 1, 1.0), (9, 2, 1.0)] and searched == [2]


def test_stem_dictionary_is_made_once(spark):
    """However often the dictionary is read, its terms are stemmed once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def stem(term):
        made.add(1)
        return term[:3]

    documents = spark.createDataFrame([(1, ["walking", "road"]), (2, ["walks", "school"])], "id long, terms array<string>")
    queries = spark.createDataFrame([(7, ["walked"])], "query_id long, terms array<string>")
    terms = spark.createDataFrame([(t,) for t in ("walking", "road", "walks", "school", "walked")], "term string")
    found = lexical.lexical_top_k(queries, documents, 2, stems=terms.withColumn("stem", stem("term")))
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(7, 1), (7, 2)]
    assert made.value == 5


def test_stems_are_joined_where_many_terms_share_them(spark):
    """However many surface terms a stem has, a task looks up a bounded number of them; rows that repeat an id stay apart."""
    rnd = random.Random(4)
    words = [f"{w}{e}" for w in ("road", "stall", "work") for e in ("", "s", "ed", "ing")]
    rows = [(i % 30, [rnd.choice(words + ["ward"]) for _ in range(rnd.randint(0, 9))], rnd.choice(["a", "b", None])) for i in range(60)] + [(99, None, "a")]
    d = spark.createDataFrame(rows, "id long, terms array<string>, scope string")
    q = spark.createDataFrame([(i, [rnd.choice(words + ["ward", "none"]) for _ in range(3)], rnd.choice(["a", "b", None])) for i in range(8)],
                              "query_id long, terms array<string>, scope string")
    stems = spark.createDataFrame([(w, w.removesuffix("s").removesuffix("ed").removesuffix("ing")) for w in words], "term string, stem string")
    for scope in (False, True):
        want, got = [sorted((r.query_id, r.id, r.lexical_rank) for r in lexical.lexical_top_k(q, d, 7, scope=scope, stems=stems, spelt_terms=n).collect())
                     for n in (100, 1)]
        assert got == want and want


def _lexical_model(queries, documents, k, scopes=None, own=None):
    """The best ``k`` of each query: ``(query, document, rank)``, one document and one term after the other."""
    found = []
    for q, asked in enumerate(queries):
        ranks = []
        for d, terms in enumerate(documents):
            shared = [terms.count(t) for t in asked if t in terms]
            if shared and (scopes is None or scopes[q] is None or scopes[q] == own[d]):
                rank = sum(sum(1 / j ** 2 for j in range(1, n + 1)) for n in shared) * 6 / np.pi ** 2 / len(asked)
                ranks.append((-round(rank, 4), d))
        found += [(q, d, -r) for r, d in sorted(ranks)[:k]]
    return found


@pytest.mark.parametrize("scope", [False, True])
@pytest.mark.parametrize("small", [False, True])
def test_counted_sums_give_the_best_ranks(monkeypatch, small, scope):
    import pyarrow as pa

    if small:
        for name, value in (("SLAB_ROWS", 70), ("ASKED", 7), ("SLAB_BYTES", 900)):
            monkeypatch.setattr(lexical, name, value, raising=False)
    rng = np.random.default_rng(3)
    words = [f"w{n}" for n in range(300)]
    share = 1 / np.arange(1, 301)
    documents = [list(rng.choice(words, rng.integers(0, 60), p=share / share.sum())) for _ in range(330)]
    documents[17] = ["w290"] * 9
    queries = [sorted(set(rng.choice(words, rng.integers(0, 30)))) for _ in range(40)] + [["w0"], ["w290"], ["other"], [], words[:200]]
    scopes = [["a", "b", "unseen", None][n % 4] for n in range(len(queries))]
    own = [["a", "b", "c", None][n % 7 % 4] for n in range(len(documents))]
    columns = {"terms": pa.array(queries, pa.list_(pa.string())), "query_id": pa.array(range(len(queries)), pa.int64())}
    index = lexical._query_index(pa.table(columns | ({"scope": pa.array(scopes)} if scope else {})), scope)
    best, offer = lexical._start(index, 5)
    held = {"id": pa.array(range(len(documents)), pa.int64()), "terms": pa.array(documents, pa.list_(pa.string()))}
    rows = pa.record_batch(held | ({"scope": pa.array(own)} if scope else {}))
    for start in reversed(range(0, len(documents), 110)):  # later ids first
        offer(rows.slice(start, 110))
    got = sorted((int(q), int(i), round(float(r), 4)) for b in best for q, i, r in b.frame("rank").itertuples(index=False))
    assert got == sorted(_lexical_model(queries, documents, 5, *([scopes, own] if scope else [])))


def test_few_pairs_are_scored_one_by_one(monkeypatch):
    """Of a first batch only pairs that may stay are ranked, not all that share a term, and no block is scored whole in double precision."""
    import pyarrow as pa

    from baraza.operators import blocked

    taken, whole = [], []
    real, offered = blocked.BestPerQuery.take, blocked.BestPerQuery.offer
    monkeypatch.setattr(blocked.BestPerQuery, "take", lambda self, who, *rest: (taken.append(len(who)), real(self, who, *rest))[1])
    monkeypatch.setattr(blocked.BestPerQuery, "offer", lambda self, *rest: (whole.append(1), offered(self, *rest))[1])
    rng = np.random.default_rng(5)
    words = [f"w{n}" for n in range(500)]
    documents = [list(rng.choice(words, 60)) for _ in range(2500)]
    queries = [sorted(set(rng.choice(words, 24))) for _ in range(50)]
    index = lexical._query_index(pa.table({"terms": pa.array(queries), "query_id": pa.array(range(50), pa.int64())}), False)
    best, offer = lexical._start(index, 8)
    offer(pa.record_batch({"id": pa.array(range(2500), pa.int64()), "terms": pa.array(documents)}))
    assert not whole and sum(taken) <= 50 * 8 * 10
    taken.clear()
    vectors, asked = rng.normal(size=(2500, 32)), rng.normal(size=(50, 32))
    vectors, asked = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (vectors, asked))
    block = knn._Block(np.arange(50), asked, 8, False)
    block.offer(vectors, vectors.astype("float32"), np.arange(2500))
    got = block.best.frame("similarity")
    assert not whole and sum(taken) <= 50 * 8 * 10
    want = [(q, i) for q in range(50) for i in np.lexsort((np.arange(2500), -np.rint(vectors @ asked[q] * 10_000)))[:8]]
    assert sorted(zip(got["query_id"], got["id"])) == sorted(want)


def test_a_first_floor_turns_no_best_row_away():
    from baraza.operators import blocked

    rng = np.random.default_rng(9)
    scores = np.round(rng.random((30, 256)), 2)  # many ties
    scores[3] = np.nan
    scores[4, 5:] = np.nan
    ids = rng.permutation(256)
    best = blocked.BestPerQuery(np.arange(30), 6)
    with np.errstate(all="raise"):
        best.raise_floor(np.fmax.reduceat(scores + rng.uniform(-1e-4, 1e-4, scores.shape), np.arange(0, 256, 4), axis=1), 1e-4)
    assert np.isneginf(best.floor[3:5]).all() and (np.delete(best.floor, [3, 4]) > 8000).all()
    best.offer(scores, ids)
    got = best.frame("score")
    for q in range(30):
        want = sorted((-round(s, 2), i) for s, i in zip(scores[q], ids) if s == s)[:6]
        assert sorted((-round(s, 2), i) for s, i in got[got.query_id == q][["score", "id"]].itertuples(index=False)) == want
