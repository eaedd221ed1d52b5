"""Phrases, hard negatives and chat windows: against plain versions over odd rows."""

import hashlib
import inspect
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from baraza.llm import chat, collocations, negatives, queries

from .helpers import ODD, documents


def plain_collocations(rows, least=30, longest=4, best=2000):
    counts, words_in = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        words_in[lang] += 0
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = [w for w in re.split("[ \t]+", piece) if w]
            words_in[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, c in counts.items():
        c = {p: n for p, n in c.items() if n >= least}
        inside = defaultdict(int)
        for p, n in c.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], n)
        scored = []
        for p, a in c.items():
            if len(p) > 1 and not (p in inside and 100 * inside[p] >= 80 * a):
                cut = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                scored.append((-cut[0], -a, " ".join(p).encode(), cut[2], cut[3]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words_in[lang], -score))
    return sorted(out)


def mined(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def worded(seed=3):
    draw = random.Random(seed)
    vocabulary = ["New", "york", "city", "é", "ß", "a", "the", "of", "x" * 50, "😀", "\x00"]
    rows = [(i, draw.choice([" ", "\t", "  "]).join(draw.choices(vocabulary, range(1, 12), k=60)) + draw.choice([".", "\n", "", "!? "]) +
             "in New York City", draw.choice(["en", "en", "fr", None, "und"])) for i in range(60)]
    return rows + [(r[0], r[1], None) for r in ODD] + [(None, "New York", "en"), (1, None, "de")] * 3


def test_collocations(spark):
    rows = worded()
    got = collocations.collocations(documents(spark, rows), filter_bits=1 << 16)
    assert mined(got) == plain_collocations(rows)
    assert mined(collocations.collocations(documents(spark, rows), least=8, best=7, filter_bits=1 << 16)) == plain_collocations(rows, 8, 4, 7)
    assert collocations.collocations(documents(spark, []), filter_bits=1 << 16).count() == 0


def test_collocations_survive_collisions_and_a_full_filter(spark):
    rows = worded(5)
    want = plain_collocations(rows, 5)
    assert mined(collocations.collocations(documents(spark, rows), least=5, print_bits=5, filter_bits=64)) == want
    assert mined(collocations.collocations(documents(spark, rows), least=5, print_bits=64, filter_bits=64)) == want


def test_fingerprints_ship_few_bytes(spark):
    """What a fingerprint adds to a shuffle is bounded; the counts stay exact, as above."""
    bits = inspect.signature(collocations.frequent_phrases).parameters["print_bits"].default
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 50, "text": [f"word {i} and {i * i} more" for i in range(50)]})
    prints = np.concatenate([b.column(0).to_numpy() for b in collocations._counted([1, 2], np.uint64((1 << bits) - 1))(iter([batch]))])
    assert len(prints) > 100 and prints.min() >= 0 and prints.max() < 1 << 40


@pytest.mark.parametrize("m, k, n", [(1, 1, 1), (3, 5, 7), (64, 64, 64), (65, 33, 129), (0, 4, 5), (130, 64, 40)])
def test_strassen(m, k, n):
    draw = np.random.default_rng(m + k + n)
    a, b = draw.integers(-(1 << 28), 1 << 28, (m, k)), draw.integers(-(1 << 28), 1 << 28, (k, n))
    want = np.array(a.astype(object) @ b.astype(object), dtype=np.int64) if m else np.zeros((0, n), np.int64)
    assert np.array_equal(negatives.strassen(a, b, 4), want)


def test_score_window():
    for p in range(-50, 500):
        low, high = negatives.score_window(np.int64(p))
        assert [n for n in range(-60, 520) if 50 * p <= 100 * n <= 95 * p] == list(range(low, high + 1))


def plain_negatives(rows, every=50):
    taken = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(256 * x) for x in v]
            if sum(x * x for x in v) < 1 << 60:
                taken[i] = min(taken.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in taken.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, m) for b, (m, w) in taken.items() if b != a)
        for p, b, m in [s for s in scored if s[2] == label][:5]:
            fit = [(n, c) for n, c, k in scored if k != label and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a, b, r, c, -p, -n) for r, (n, c) in enumerate(fit, 1)]
    return sorted(out)


def embedded(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, label int, rank string, cell double")


def vectors(n=400, width=5):
    draw = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in draw.integers(-6, 30, width) / 8], int(draw.integers(0, 3))) for i in range(n)]
    rows += [(n + i, rows[0][1], i % 2) for i in range(80)]  # one common vector
    odd = [(50, None, 1), (100, [1.0] * 5, None), (None, [1.0] * 5, 1), (601, [1.0, None, 1.0, 1.0, 1.0], 1), (602, [float("nan")] * 5, 1),
           (603, [float("inf")] * 5, 1), (604, [], 2), (650, [2.0], 1), (605, [1e12] * 5, 2), (606, [1e30] * 5, 2), (7, [3.0] * 5, 0), (750, [9.0] * 5, 9)]
    return rows + odd + rows[:60]


@pytest.mark.parametrize("options", [{}, {"part_values": 20, "strip_rows": (64, 64)}])
def test_hard_negatives(spark, options):
    rows = vectors()
    got = negatives.hard_negatives(embedded(spark, rows), F.col("vec_id") % 50 == 0, **options)
    want = plain_negatives(rows)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 30


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(50, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 1)]):
        assert negatives.hard_negatives(embedded(spark, rows), F.col("vec_id") % 50 == 0).count() == 0


ROLES = ["user", "assistant", "system", "tool", "", None, "a[/ROLE]b"]
PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "\\", "<", "[", "\n", "é😀", "ok ", "s>", "/s>"]


def plain_digests(rows):
    grouped = defaultdict(list)
    for conv, turn, role, text in rows:
        grouped[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in grouped.items():
        turns.sort(key=lambda t: t[:3])
        said = [t[3] for t in turns if t[2] == "assistant"]
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(),
                     sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def tokenizer():
    with open(queries.tokenizer_file(queries.RANKS), "rb") as f:
        return "byte_bpe_50k", queries.RANKS_PATTERN, f.read()


def talks():
    draw = random.Random(11)
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 0, "user", "q"), (None, 1, "assistant", "a"),
            (1, 0, "system", "only"), (2, 0, "assistant", None), (2, None, "user", ""), (3, 0, "system", "be brief " * 40), (3, 1, "assistant", "long " * 900), (3, 2, "user", "end")]
    for conv in range(10, 30):
        if conv % 2:
            rows.append((conv, 0, "system", "rules " * draw.randrange(30)))
        rows += [(conv, 3 * i + 1, draw.choice(ROLES), "".join(draw.choices(PARTS, k=draw.randrange(30)))) for i in range(draw.randrange(1, 60))]
    return rows


def talk_table(spark, rows):
    return spark.createDataFrame([(*r, 5, "z", 0) for r in rows], "conv_id long, turn long, role string, text string, window int, key string, n_tokens int")


@pytest.mark.parametrize("options", [{"budget": 200, "history": 40}, {"budget": 200, "history": 0, "ranges": 7}, {"budget": 4, "history": 90}, {}])
def test_chat_round_trip(spark, tokenizer, options):
    rows = talks()
    windows = chat.format_windows(talk_table(spark, rows), *tokenizer, **options)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
    assert got == plain_digests(rows)


def test_chat_windows(spark, tokenizer):
    """Every window against one built turn by turn: budget, lead, history, spans."""
    rows, budget, history = talks(), 200, 40
    windows = defaultdict(list)
    for r in chat.format_windows(talk_table(spark, rows), *tokenizer, budget=budget, history=history).orderBy("window").collect():
        windows[r.conv_id].append(r)
    cost = {(r["role"], r["text"]): r["n_tokens"] for r in chat.with_tokens(talk_table(spark, rows).drop("n_tokens").select(
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rendered", chat.render(F.col("role"), F.col("text"))), *tokenizer).collect()}
    for conv, found in windows.items():
        seen = []
        for w in found:
            turns = chat.parse(w.text)
            assert w.n_tokens == sum(cost[t] for t in turns)
            old, new = turns[:w.n_repeated], turns[w.n_repeated:]
            assert new
            lead = [seen[0]] if seen and seen[0][0] == "system" else []
            assert old[:len(lead)] == lead
            again = old[len(lead):]
            assert not again or seen[-len(again):] == again
            assert sum(cost[t] for t in again) <= history
            room = sum(cost[t] for t in lead)
            if w.n_tokens > budget:  # one long turn, or a lead beyond half the budget
                assert len([t for t in new if t[0] != "system"]) == 1 or room > budget // 2
            earlier = seen[len(lead):-len(again)] if again else seen[len(lead):]
            half = max((budget - history - room) // 2, budget // 4, 1)
            if earlier and lead == ([seen[0]] if seen[0][0] == "system" else []):  # the history could not be longer
                assert sum(cost[t] for t in again) + cost[earlier[-1]] > min(history, half)
            spans = [chat.unescape(w.text[s["start"]:s["end"]]) for s in w.loss]
            assert spans == [t[1] for t in new if t[0] == "assistant"]
            seen += new
    assert any(len(x) > 3 for x in windows.values())


def test_chat_of_nothing(spark, tokenizer):
    assert chat.read_back(chat.format_windows(talk_table(spark, []), *tokenizer)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12))
def test_escapes_are_reversible(parts):
    """The pattern that the JVM applies, in Python's dialect."""
    text = "".join(parts)
    escaped = re.sub(f"({chat._OPEN})", r"\1" + "\\\\", text)
    assert chat.unescape(escaped) == text
    assert not any(m in escaped for m in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"))
