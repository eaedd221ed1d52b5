"""Merging ranked lists and judging them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baraza import fixed_values as fv
from baraza.operators.topk import top_k


def best_per_variant(hits: DataFrame, k: int) -> DataFrame:
    """Keep each hit's best similarity over the query's variants, then the ``k`` best hits."""
    best = hits.groupBy("query_id", "id").agg(F.max(F.round("similarity", 4)).alias("similarity"))
    return top_k(best, ["query_id"], [F.desc("similarity"), F.asc("id")], k)


def reciprocal_rank_fusion(lists: list[DataFrame], k: int, constant: int = fv.RRF_CONSTANT) -> DataFrame:
    """Sum ``1/(constant + rank)`` over any number of ranked lists and keep the ``k`` best.

    Each list has ``query_id, id, rank`` and optionally ``similarity`` or ``lexical_rank``; both
    survive the fusion. Equal scores keep the order of the lists, then the rank inside the list.
    """
    scores = ["similarity", "lexical_rank"]
    ranked = [
        part.select("query_id", "id", F.col("rank").cast("int").alias("list_rank"), F.lit(i).alias("list_no"),
                    *[(F.col(s) if s in part.columns else F.lit(None)).cast("double").alias(s) for s in scores])
        for i, part in enumerate(lists)]
    union = ranked[0]
    for part in ranked[1:]:
        union = union.unionByName(part)
    fused = union.groupBy("query_id", "id").agg(
        F.round(F.sum(1.0 / (F.col("list_rank") + constant)), 9).alias("score"),
        F.min(F.struct("list_no", "list_rank")).alias("_first"),
        *[F.max(s).alias(s) for s in scores])
    ordered = top_k(fused, ["query_id"],
                    [F.desc("score"), F.asc("_first.list_no"), F.asc("_first.list_rank"), F.asc("id")], k)
    return ordered.drop("_first")


def is_weak(similarity: Column, lexical_rank: Column, hits: Column, threshold: float = fv.WEAK_SIMILARITY) -> Column:
    """No hit, or neither a confident similarity nor any lexical match."""
    confident = (F.coalesce(similarity, F.lit(0.0)) >= threshold) | (F.coalesce(lexical_rank, F.lit(0.0)) > 0)
    return ~confident | (hits == 0)


def weak_retrieval(queries: DataFrame, hits: DataFrame, threshold: float = fv.WEAK_SIMILARITY) -> DataFrame:
    """``(query_id, ..., best_similarity, best_lexical, hit_count, weak)`` for every query, with or without hits."""
    best = hits.groupBy("query_id").agg(
        F.max("similarity").alias("best_similarity"), F.max("lexical_rank").alias("best_lexical"),
        F.count("*").alias("hit_count"))
    joined = queries.join(best, "query_id", "left").fillna(0, ["hit_count"])
    return joined.withColumn("weak", is_weak(F.col("best_similarity"), F.col("best_lexical"), F.col("hit_count"), threshold))
