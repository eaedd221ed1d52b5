"""From raw documents to token ids: what has no language, copies, near copies and benchmark passages go; the rest is encoded."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baraza.llm import bagminhash, containment, language, queries, recipes, unigram
from baraza.llm.common import read
from baraza.session import run_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a word of any language."""
    return language.keep_known(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest ``doc_id`` stays."""
    return recipes.keep_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the smallest ``doc_id`` stays."""
    return bagminhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return containment.without_items(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``token_ids``, their number, and whether they decode to the text."""
    pieces = unigram.Pieces.load(queries.tokenizer_file(queries.PIECES))
    back = unigram.decode(unigram.encode(docs, pieces), pieces)
    return (back.withColumn("n_tokens", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).cast("long"))
            .withColumn("round_trip", F.col("text").eqNullSafe(F.col("decoded"))).drop("decoded"))


STAGES = [
    ("language", known_language),
    ("exact", exact_copies),
    ("near", near_copies),
    ("benchmark", benchmark_passages),
    ("encode", encoded),
]

#: The fitted language field and the Viterbi paths have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = run_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
