"""Personal data: exact base patterns, and secrets found by labelers that vote.

Base spans come from fixed patterns and are always reported. Beyond them every token of letters and digits is a candidate
for a secret. Regex, gazetteer and context labelers vote for, against or not at all; expectation-maximisation estimates
how far each labeler can be trusted, without any labelled row; the posteriors it gives train the final span classifier,
a naive Bayes model over the candidate's shape and surroundings, which decides on every candidate.

All work on rows is DataFrame expressions. The two models see candidates only as counts of vote and shape patterns, at
most ``3 ** len(VOTES)`` times the product of the shapes' values, whatever the size of the table.

* A null or empty text has no spans: counts 0, empty strings (the hash of the empty string).
* Offsets are code points, ends exclusive. Spans of a kind don't overlap; candidates inside a base span are not reported again.
* Null ids and repeated rows are rows like any other; columns besides ``doc_id`` and ``text`` are ignored; an empty table
  gives an empty result.
"""

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baraza.llm.text import places

# Possessive forms and looks behind keep the patterns linear; they match what the plain patterns match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TOKEN = r"(?<![A-Za-z0-9_+/@.%-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{6,}+(?![@.][A-Za-z0-9])"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Words before a secret, and before harmless numbers.
NAMES = "password passwd passphrase pwd secret token key apikey api_key access_key auth bearer credential credentials".split()
HARMLESS = "page chapter section figure table version volume number no issue part article line item lot room flight model".split()
VOTES = ("known_form", "long_hex", "mixed", "named", "assigned")
ACCEPT = 0.9


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(places(n), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    n = F.length(_digits(match))
    if kind == "phone":
        return n.between(8, 15)
    return n.between(16, 19) & F.when(n.between(16, 19), _luhn(_digits(match))).otherwise(False)


def _spans(matches: Column, between: Column) -> Column:
    """``start, end, text, before`` of all matches, from the matches and the texts between them."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, text: string, before: string>>").alias("found"))

    def add(state, i):
        start = state["at"] + F.length(F.get(between, i))
        end = start + F.length(F.get(matches, i))
        own = F.struct(start.alias("start"), end.alias("end"), F.get(matches, i).alias("text"), F.right(F.get(between, i), F.lit(24)).alias("before"))
        return F.struct(end.alias("at"), F.array_append(state["found"], own).alias("found"))

    return F.aggregate(places(F.size(matches)), empty, add)["found"]


def _filtered(kind: str) -> Column:
    return F.filter(kind, lambda s: _valid(kind, s["text"]))


def _written(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def found_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, email, ip, card, phone, token``: valid base spans and candidate tokens of each text."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    patterns = PATTERNS | {"token": TOKEN}
    cut = texts.select("doc_id", *[c for k, p in patterns.items() for c in (
        F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"{k}_m"), F.split("text", p, -1).alias(f"{k}_b"))])
    spans = cut.select("doc_id", *[_spans(F.col(f"{k}_m"), F.col(f"{k}_b")).alias(k) for k in patterns])
    kept = spans.select("doc_id", "token", *[_filtered(k).alias(k) for k in PATTERNS])
    covered = F.concat(*PATTERNS)
    return kept.withColumn("token", F.filter("token", lambda t: ~F.exists(covered, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))


def _vote(for_: Column, against: Column) -> Column:
    return F.when(for_, 1).when(against, -1).otherwise(0)


def _pattern(token: Column) -> Column:
    """The votes on a candidate and its shape."""
    text, before = token["text"], token["before"]
    size = F.length(text)
    name = F.regexp_extract(F.lower(before), r"([a-z_]+)[^a-z_]{0,4}$", 1)
    turns = F.length(F.regexp_replace(text, "(?:[0-9]+|[^0-9]+)", "x"))
    signed = before.rlike(r"[:=][\x20\"']{0,3}$")
    votes = [
        _vote(text.rlike("^(?:AKIA|ASIA)[0-9A-Z]{16}$") | text.rlike("^(?:ghp|gho|sk|pk|xox[bp])[_-][A-Za-z0-9_-]{16,}$"), size < 8),
        _vote(text.rlike("^[0-9a-f]{16,}$"), text.rlike("^[A-Za-z]+[0-9]{1,4}$")),
        _vote((turns >= 5) & (size >= 12), (turns <= 2) | (size < 10)),
        _vote(name.isin(*NAMES), name.isin(*HARMLESS)),
        _vote(signed, before.rlike(r"[a-z,;]\x20$")),
    ]
    shape = [F.least(F.floor(size / 8), F.lit(5)).cast("int"), F.least(F.floor(turns / 3), F.lit(4)).cast("int"), name.isin(*NAMES).cast("int"), signed.cast("int"),
             text.rlike("[A-Z]").cast("int"), text.rlike("[a-z]").cast("int"), text.rlike("[_+/-]").cast("int")]
    return F.struct(F.array(*votes).alias("votes"), F.array(*shape).alias("shape"))


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """The probability of being a secret for each pattern of votes, by expectation-maximisation.

    Starts at the balance of the votes. A labeler's chances of each vote are estimated by class, smoothed by one vote.
    """
    post = {v: 1 / (1 + math.exp(-2.0 * sum(v))) for v in counts}
    for _ in range(rounds):
        share = [1.0, 1.0]
        chance = [[defaultdict(lambda: 1.0) for _ in VOTES] for _ in (0, 1)]
        for v, n in counts.items():
            for c, p in ((1, post[v]), (0, 1 - post[v])):
                share[c] += n * p
                for k, vote in enumerate(v):
                    chance[c][k][vote] += n * p
        after = {}
        for v in counts:
            odds = math.log(share[1] / share[0]) + sum(
                math.log(chance[1][k][vote] / (share[1] + 2)) - math.log(chance[0][k][vote] / (share[0] + 2)) for k, vote in enumerate(v))
            after[v] = 1 / (1 + math.exp(max(-500.0, min(500.0, -odds))))
        moved = max((abs(after[v] - post[v]) for v in counts), default=0.0)
        post = after
        if moved < 1e-9:
            break
    return post


def train(found: DataFrame) -> tuple[float, list[dict[int, float]]]:
    """The classifier: its bias and, for each part of the shape, the weight of each value."""
    patterns = found.select(F.explode(F.transform("token", _pattern)).alias("p")).groupBy("p").count().collect()  # bounded: see above
    votes: dict[tuple[int, ...], float] = defaultdict(float)
    for r in patterns:
        votes[tuple(r["p"]["votes"])] += r["count"]
    post = reliabilities(dict(votes))
    total, weights = [1.0, 1.0], [defaultdict(lambda: [1.0, 1.0]) for _ in range(7)]
    for r in patterns:
        p = post[tuple(r["p"]["votes"])]
        for c, share in ((1, p), (0, 1 - p)):
            total[c] += r["count"] * share
            for k, value in enumerate(r["p"]["shape"]):
                weights[k][value][c] += r["count"] * share
    logs = [{value: math.log(n[1] / (total[1] + len(w))) - math.log(n[0] / (total[0] + len(w))) for value, n in w.items()} for w in weights]
    return math.log(total[1] / total[0]), logs


def _accepted(model: tuple[float, list[dict[int, float]]], token: Column) -> Column:
    bias, weights = model
    pattern = _pattern(token)
    odds = F.lit(bias)
    for k, w in enumerate(weights):
        value, step = F.get(pattern["shape"], F.lit(k)), F.lit(0.0)
        for v, x in sorted(w.items()):
            step = F.when(value == v, F.lit(x)).otherwise(step)
        odds = odds + step
    return odds >= math.log(ACCEPT / (1 - ACCEPT))


def label(docs: DataFrame) -> DataFrame:
    """``doc_id`` and, as arrays of ``start, end, text, before``, the spans ``email, ip, card, phone`` and ``secret``."""
    found = found_spans(docs)
    model = train(found)
    if not model[1][0]:  # no candidate anywhere
        return found.withColumnRenamed("token", "secret")
    return found.withColumn("secret", F.filter("token", lambda t: _accepted(model, t))).drop("token")


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every document."""
    def listed(kinds):
        return F.array_join(F.concat(*map(_written, kinds)), ",")

    return label(docs).select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
                              F.sha2(listed(PATTERNS), 256).alias("base_sha256"), listed([*PATTERNS, "secret"]).alias("spans"))
