"""Conversations as training windows of a token budget, whose loss mask covers every assistant text exactly once.

Prefix sums of the turns' tokens (``operators.numbered``: no task holds a conversation) place each turn in a bin of half the room
that the budget leaves beside the system turn and the repeated history. The turns of a bin make a window, so a window's
new turns fill at most the room; a turn of more than half the room stands alone. Before a window's first new turn the turns
of at most ``history`` tokens are repeated, whole ones only, and the conversation's first turn, if it is a system turn, leads every
window. Only turns that are new in a window are under its mask.

The template: ``<s>`` and ``</s>`` around every turn, ``[INST]`` and ``[/INST]`` inside for users, ``<<SYS>>`` and ``<</SYS>>`` for
system turns, nothing more for assistants, ``[ROLE]name[/ROLE]`` before the text for any other role. Where a text holds one of these
strings, a backslash follows its first character, and one more where backslashes already stand there; nothing else changes.

* Nothing is cut or dropped: a turn longer than the room makes a window beyond the budget.
* A null text or role is empty; rows with a null ``conv_id`` are one conversation; a null ``turn`` comes first.
* Rows of one conversation and turn come by role, then by a hash of the text; repeated rows are turns of their own.
* An empty table gives no windows. Further columns are ignored.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baraza.llm.common import in_batches, stored
from baraza.llm.rollup import _encoding
from baraza.operators.numbered import prefix_sums

BUDGET, HISTORY = 2048, 256
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("", "")}
_OPEN = r"(?:<(?=\\*(?:/?s>|<SYS>>|</SYS>>))|\[(?=\\*/?(?:INST|ROLE)\]))"
_ESCAPED = re.compile(r"(<)\\(?=\\*(?:/?s>|<SYS>>|</SYS>>))|(\[)\\(?=\\*/?(?:INST|ROLE)\])")
_TURN = re.compile(r"<s>(.*?)</s>", re.DOTALL)
_OTHER = re.compile(r"\[ROLE\](.*?)\[/ROLE\](.*)", re.DOTALL)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({_OPEN})", r"$1\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or m[2], text)


def render(role: Column, text: Column) -> Column:
    """One turn in the template."""
    body = F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]"), escape(text))
    for name, (before, after) in MARKS.items():
        body = F.when(role == name, F.concat(F.lit(before), escape(text), F.lit(after))).otherwise(body)
    return F.concat(F.lit("<s>"), body, F.lit("</s>"))


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a window: role and text."""
    turns = []
    for body in _TURN.findall(text):
        other = _OTHER.fullmatch(body)
        if other:
            turns.append((unescape(other[1]), unescape(other[2])))
            continue
        role = next(r for r, (before, _) in MARKS.items() if body.startswith(before))
        before, after = MARKS[role]
        turns.append((role, unescape(body[len(before):len(body) - len(after)])))
    return turns


def with_tokens(turns: DataFrame, name: str, pattern: str, ranks: bytes) -> DataFrame:
    """Add ``n_tokens`` of the column ``rendered``. ``ranks``: the content of a rank file, read once on the driver."""
    columns = turns.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(name, pattern, ranks)
        for batch in batches:
            n = pa.array([len(encoding.encode_ordinary(t.as_py())) for t in batch.column("rendered")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=[*columns, "n_tokens"])

    kinds = ", ".join(f"{n} {k}" for n, k in turns.dtypes)
    return in_batches(turns, count, f"{kinds}, n_tokens long")


def format_windows(turns: DataFrame, name: str, pattern: str, ranks: bytes, *, budget: int = BUDGET, history: int = HISTORY,
                   ranges: int | None = None) -> DataFrame:
    """``conv_id, window, text, n_tokens, n_repeated, loss``: a conversation's windows in order of ``window``.

    The first ``n_repeated`` turns of ``text`` stand in an earlier window too. ``loss`` lists the spans (``start``, ``end``; code points, end
    exclusive) that are trained on.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    plain = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("conv_id").cast("long").alias("conv_id"),
                         F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(text).alias("tie"), render(role, text).alias("rendered"))
    # written once, with a number for each row: what follows decides on narrow rows and fetches the texts at the end
    counted = stored(with_tokens(plain, name, pattern, ranks).withColumn("row", F.monotonically_increasing_id()), "counted")
    narrow = counted.drop("rendered")
    placed = stored(prefix_sums(narrow, ["key"], ["turn", "role", "tie"], {"number": F.lit(1).cast("long"), "before": F.col("n_tokens")},
                                ranges=ranges), "turns")
    leads = (F.col("number") == 0) & (F.col("role") == "system")
    system = placed.where(leads).select("key", "conv_id", "row", "number", "n_tokens")

    rest = placed.where(~leads).join(system.select("key", F.col("n_tokens").alias("lead")), "key", "left").withColumn("lead", F.coalesce("lead", F.lit(0)))
    half = F.greatest((F.lit(budget - history) - F.col("lead")) / 2, F.lit(budget) / 4, F.lit(1)).cast("long")
    rest = rest.withColumn("half", half).withColumn("before", F.col("before") - F.col("lead"))
    long = F.col("n_tokens") > F.col("half")
    rest = rest.withColumn("window", 2 * F.floor(F.col("before") / F.col("half")).cast("long") + long.cast("long"))
    firsts = rest.groupBy("key", "window").agg(F.min("before").alias("first"))

    columns = ["key", "conv_id", "window", "row", "number", "repeated", "n_tokens"]
    own = rest.withColumn("repeated", F.lit(False)).select(*columns)
    # the history is at most a bin long, so a turn is repeated in the windows of its own and the next bin only
    allowed = F.least(F.lit(history), F.col("half"))
    after = rest.where(~long).withColumn("window", F.explode(F.array(*[F.col("window") + i for i in (1, 2, 3)])))
    copies = (after.join(firsts, ["key", "window"]).where(F.col("first") - F.col("before") <= allowed)
              .withColumn("repeated", F.lit(True)).select(*columns))
    opening = firsts.groupBy("key").agg(F.min("window").alias("opening"))
    lead = system.join(opening, "key", "left").withColumn("opening", F.coalesce("opening", F.lit(0).cast("long")))
    led = lead.withColumn("window", F.col("opening")).withColumn("repeated", F.lit(False)).select(*columns)
    again = lead.join(firsts, "key").where(F.col("window") > F.col("opening")).withColumn("repeated", F.lit(True)).select(*columns)

    # a window's turns are bounded by the budget, save for one longer turn
    members = own.unionByName(copies).unionByName(led).unionByName(again).join(counted.select("row", "role", "rendered"), "row")
    listed = F.array_sort(F.collect_list(F.struct("number", "repeated", "role", "rendered", "n_tokens"))).alias("turns")
    windows = members.groupBy("key", "conv_id", "window").agg(listed)
    lengths = F.transform("turns", lambda t: F.length(t["rendered"]))
    starts = F.transform("turns", lambda t, i: F.aggregate(F.slice("lengths", 1, i), F.lit(0), lambda s, x: s + x))
    spans = F.transform("turns", lambda t, i: F.struct(
        (F.get("starts", i) + 3).alias("start"), (F.get("starts", i) + F.get("lengths", i) - 4).alias("end"),
        (~t["repeated"] & (t["role"] == "assistant")).alias("trained")))
    return (windows.withColumn("lengths", lengths).withColumn("starts", starts).select(
        "conv_id", "window", F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("text"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["n_tokens"]).alias("n_tokens"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
        F.transform(F.filter(spans, lambda s: s["trained"]), lambda s: F.struct(s["start"], s["end"])).alias("loss")))


def read_back(windows: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, from the windows alone.

    A digest runs along the whole conversation, so a task streams its windows in order and keeps the two digests only.
    """
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def closed():
            conv, turns, seen, loss, chars, total = state
            return conv, turns, seen.hexdigest(), chars, loss.hexdigest(), total

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["key"] != key:
                    if state:
                        done.append(closed())
                    key, state = row["key"], [row["conv_id"], 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                for role, text in parse(row["text"])[row["n_repeated"]:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    text = unescape(row["text"][span["start"]:span["end"]])
                    state[3].update(text.encode())
                    state[4] += len(text)
                state[5] += len(row["text"])
            if len(done) >= 1000:
                yield _batch(columns, done)
                done = []
        if state:
            done.append(closed())
        yield _batch(columns, done)

    keyed = windows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    ordered = keyed.select("key", "conv_id", "window", "text", "n_repeated", "loss").repartition("key").sortWithinPartitions("key", "window")
    return in_batches(ordered, digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
