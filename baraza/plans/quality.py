"""Answer ratings: intake checks, the review queue and quality statistics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baraza import fixed_values as fv
from baraza.operators.grouped import counts_by_value
from baraza.operators.topk import page_of
from baraza.session import shared_folder
from baraza.plans.conversations import with_preceding


def check_ratings(ratings: DataFrame, messages: DataFrame, registers=tuple(fv.REGISTERS)) -> DataFrame:
    """Ratings with ``accepted`` and ``reject_reason``; the first failing check names the reason."""
    roles = messages.select(F.col("id").alias("message_id"), F.col("role").alias("_role"))
    reason = (F.when(~F.col("tone_score").between(1, 5), "tone_out_of_range")
              .when(~F.col("register").isin(list(registers)), "unknown_register")
              .when(F.col("_role").isNull(), "message_not_found")
              .when(F.col("_role") != "assistant", "not_an_answer"))
    return (ratings.join(roles, "message_id", "left").withColumn("reject_reason", reason)
            .withColumn("accepted", F.col("reject_reason").isNull()).drop("_role"))


def unrated_answers(messages: DataFrame, validations: DataFrame) -> DataFrame:
    rated = validations.select(F.col("message_id").alias("id")).distinct()
    return messages.where(F.col("role") == "assistant").join(rated, "id", "left_anti")


def review_queue(messages: DataFrame, validations: DataFrame, limit: int = 10, seed: str | None = None) -> DataFrame:
    """A random sample of unrated answers with their questions; ``seed`` makes the draw repeatable."""
    draw = F.rand() if seed is None else F.md5(F.concat(F.lit(seed), F.lit("-"), F.col("id").cast("string")))
    drawn = page_of(unrated_answers(messages, validations).withColumn("_draw", draw), [F.asc("_draw"), F.asc("id")], limit)
    # a random draw must be made once; questions are then looked up in the drawn sessions only
    shared_folder(messages.sparkSession)
    drawn = drawn.select("id", "session_id", "_draw").checkpoint()
    asked = with_preceding(messages.join(drawn.select("session_id").distinct(), "session_id", "left_semi"))
    return asked.join(drawn.select("id", "_draw"), "id").orderBy("_draw", "id").select(
        F.col("id").alias("message_id"), "question", F.col("text").alias("answer"), "citation")


def validation_stats(validations: DataFrame, messages: DataFrame, registers=tuple(fv.REGISTERS)) -> DataFrame:
    """One row: totals, average tone, grounding share, counts per register and answers still unrated."""
    stats = validations.agg(
        F.count("*").alias("total_validations"), F.round(F.avg("tone_score"), 2).alias("average_tone"),
        F.count_if(F.col("grounded")).alias("grounded_count"), *counts_by_value(F.col("register"), registers, "register_"))
    share = F.when(F.col("total_validations") > 0, F.round(100 * F.col("grounded_count") / F.col("total_validations"), 1))
    pending = unrated_answers(messages, validations).agg(F.count("*").alias("pending_review"))
    return one_row(stats.withColumn("grounded_pct", share), pending)


def one_row(*singles: DataFrame) -> DataFrame:
    """Side by side: several one-row aggregates as one row."""
    keyed = [s.withColumn("_one", F.lit(1)) for s in singles]
    joined = keyed[0]
    for other in keyed[1:]:
        joined = joined.join(other, "_one")
    return joined.drop("_one")
