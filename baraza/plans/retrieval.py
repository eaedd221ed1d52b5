"""Hybrid retrieval and routing for whole tables of questions."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baraza import fixed_values as fv
from baraza.functions import text as tx
from baraza.functions.stemming import stem_dictionary
from baraza.operators.fusion import best_per_variant, is_weak, reciprocal_rank_fusion
from baraza.operators.knn import nearest
from baraza.operators.lexical import lexical_top_k, stemmed_queries, written_stems
from baraza.session import run_folder, shared_folder

Embed = Callable[[DataFrame], DataFrame]
Stem = Callable[[DataFrame], DataFrame]


def variant_rows(queries: DataFrame) -> DataFrame:
    """One row per query variant: ``query_id, variant, text`` (and ``scope`` if present)."""
    kept = [c for c in ("query_id", "scope") if c in queries.columns]
    return queries.select(*kept, F.posexplode(tx.query_variants(F.col("text"))).alias("variant", "text"))


def hybrid_hits(queries: DataFrame, chunks: DataFrame, embed: Embed, k: int = fv.TOP_K, *, scope: bool = False,
                variants: bool = True, lexical: bool = True, variant_k: int | None = fv.VARIANT_TOP_K_CAP,
                stems: DataFrame | None = None, stem: Stem | None = stem_dictionary) -> DataFrame:
    """``(query_id, id, rank, score, similarity, lexical_rank)``: the fused ``k`` best chunks per query.

    ``queries``: ``query_id, text[, scope]``; ``chunks``: ``id, chunk_text, embedding[, government_arm]``.
    ``embed`` adds ``vector`` to a table with ``text``. Without ``variants`` and ``lexical`` this is plain vector search.
    ``variant_k`` bounds what one variant finds by vector, however large ``k`` is; null leaves it at ``k``.
    The lexical list meets on stems: ``stem`` makes the dictionary of a table of terms, ``stems`` (``term, stem``) is that of the chunks' terms
    where it is stored with them; without ``stem`` terms meet as they are. Chunks may bring their ``terms`` along, and ``stemmed``, the stems of those by the same dictionary.
    A column ``hit_limit`` (at most ``k``) searches single queries less deeply: a shorter list is a prefix of the longer.
    """
    scoped = ["scope"] if scope else []
    asked = variant_rows(queries) if variants else queries.select("query_id", *scoped, F.lit(0).alias("variant"), "text")
    # A text model is costly and the query vectors are read more than once: keep them.
    shared_folder(queries.sparkSession)
    # The number given to each (query, variant) is fixed by the checkpoint, whatever the ids are.
    keyed = embed(asked).select(F.monotonically_increasing_id().alias("search"), "query_id", "variant", "vector", *scoped).checkpoint()
    vectors = chunks.select("id", F.col("embedding").alias("vector"),
                            *([F.col("government_arm").alias("scope")] if scope else []))
    # Variants and questions with the same vector are one search.
    same = [keyed["vector"].eqNullSafe(F.col("_vector")), *([keyed["scope"].eqNullSafe(F.col("_scope"))] if scope else [])]
    distinct = keyed.groupBy(F.col("vector").alias("_vector"), *[F.col(c).alias(f"_{c}") for c in scoped]).agg(F.min("search").alias("_search"))
    searches = distinct.select(F.col("_search").alias("query_id"), F.col("_vector").alias("vector"), *[F.col(f"_{c}").alias(c) for c in scoped])
    near = nearest(searches, vectors, k if variant_k is None else min(k, variant_k), scope=scope).withColumnRenamed("query_id", "search")
    asking = keyed.join(distinct, same).select(F.col("_search").alias("search"), "query_id")
    near = near.join(asking, "search").drop("search")

    def limited(ranked: DataFrame) -> DataFrame:
        if "hit_limit" not in queries.columns:
            return ranked
        limits = queries.select("query_id", "hit_limit")
        return ranked.join(limits, "query_id").where(F.col("rank") <= F.col("hit_limit")).drop("hit_limit")

    lists = [limited(best_per_variant(near, k))]
    if lexical:
        terms = queries.select("query_id", *scoped, tx.lexical_terms(tx.lexicon_translation(F.col("text"))).alias("terms"))
        arm = [F.col("government_arm").alias("scope")] if scope else []
        own = written_stems(stem(terms.select(F.explode("terms").alias("term"))).select("term", "stem")) if stem is not None else None
        if stem is not None and "stemmed" in chunks.columns:
            # both sides are stems already: no surface term is spelt out, however many share a stem
            terms = stemmed_queries(terms, own if stems is None else own.union(stems.select("term", "stem")))
            found = lexical_top_k(terms, chunks.select("id", F.col("stemmed").alias("terms"), *arm), k, scope=scope)
        else:
            held = F.col("terms") if "terms" in chunks.columns else tx.lexical_terms(F.col("chunk_text"))
            corpus = chunks.select("id", held.alias("terms"), *arm)
            if stem is not None:
                known = stems if stems is not None else written_stems(stem(corpus.select(F.explode("terms").alias("term"))))
                stems = known.select("term", "stem").union(own)  # both are tables, so the larger one is not copied
            found = lexical_top_k(terms, corpus, k, scope=scope, stems=stems if stem is not None else None, stored=True)
        lists.append(limited(found))
    return limited(reciprocal_rank_fusion(lists, k))


def with_chunk_details(hits: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Add source, title, page, text and arm to hits.

    Hits - at most ``k`` a query - are written first, so their true size is known when the join is planned: below Spark's
    threshold they are broadcast and no chunk text is shuffled.
    """
    path = run_folder(hits.sparkSession, "hits")
    hits.write.parquet(path)
    hits = hits.sparkSession.read.schema(hits.schema).parquet(path)
    details = chunks.select("id", "source_id", "page_number", "chunk_text", "government_arm")
    titles = sources.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"))
    return hits.join(details, "id").join(titles, "source_id", "left")


def hits_per_query(hits: DataFrame) -> DataFrame:
    """The ranked hits of a query as one array (bounded by ``k``), with their count and best scores."""
    fields = ["rank", "id", "source_id", "source_title", "page_number", "government_arm", "chunk_text",
              "similarity", "lexical_rank"]
    return hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("hits"), F.count("*").alias("hit_count"),
        F.max("similarity").alias("best_similarity"), F.max("lexical_rank").alias("best_lexical"))


def context_text(hits: Column) -> Column:
    """Numbered passages for grounding: ``[1] Source chunk (page 3):`` and the text."""
    blocks = F.transform(hits, lambda h, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] Source chunk (page "), h["page_number"].cast("string"),
        F.lit("):\n"), h["chunk_text"]))
    return F.array_join(blocks, "\n\n")


def conversation_text(history: Column) -> Column:
    turns = F.transform(history, lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return F.when(F.size(history) > 0, F.concat(
        F.lit("CONVERSATION SO FAR:\n"), F.array_join(turns, "\n"), F.lit("\n\n"))).otherwise("")


def grounded_prompt(history: Column, hits: Column, query: Column) -> Column:
    return F.concat(conversation_text(history), F.lit("CONTEXT:\n"), context_text(hits),
                    F.lit("\n\n<QUESTION>\n"), query, F.lit("\n</QUESTION>"))


def snippets(hits: Column, count: int = 4, chars: int = 300) -> Column:
    """The first hits, shortened, as a bullet list."""
    cut = F.transform(F.slice(hits, 1, count), lambda h: F.concat(F.lit("- "), F.left(h["chunk_text"], F.lit(chars))))
    return F.when(F.size(hits) > 0, F.array_join(cut, "\n")).otherwise("(none)")


def anchored_query(query: Column, history: Column, max_words: int = fv.FOLLOWUP_MAX_WORDS) -> Column:
    """A terse follow-up gets the latest earlier user turn in front."""
    user_turns = F.filter(history, lambda m: m["role"] == "user")
    latest = F.try_element_at(user_turns, F.lit(-1))["text"]
    terse = (tx.word_count(query) <= max_words) & latest.isNotNull()
    return F.when(terse, tx.strip(F.concat_ws(" ", latest, query))).otherwise(query)


def clarify_prompt(history: Column, hits: Column, query: Column) -> Column:
    """The conversation, the question and the first snippets, for a model that asks back once."""
    return F.concat(conversation_text(history), F.lit("<QUESTION>\n"), query, F.lit("\n</QUESTION>\n\n<SNIPPETS>\n"), snippets(hits), F.lit("\n</SNIPPETS>"))


VALUE_HITS = 3


def value_prompt(hits: Column, query: Column) -> Column:
    """Numbered passages and the question, for a value-for-money comparison."""
    blocks = F.transform(hits, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["chunk_text"]))
    return F.concat(F.array_join(blocks, "\n\n"), F.lit("\n\n"), query)


def route(query: Column, weak: Column, hit_count: Column) -> Column:
    return (F.when(tx.is_value_for_money(query) & (hit_count > 0), "value_for_money")
            .when(weak & (tx.word_count(query) <= fv.CLARIFY_MAX_WORDS), "clarify")
            .when(hit_count == 0, "no_answer").otherwise("generate"))


def plan_responses(queries: DataFrame, chunks: DataFrame, sources: DataFrame, embed: Embed,
                   k: int = fv.TOP_K, stems: DataFrame | None = None, stem: Stem | None = stem_dictionary) -> DataFrame:
    """One row per question: route, retrieval query, hits and the prompt for its route.

    ``queries``: ``query_id, text, history`` and optionally ``translation`` (a supplied English text).
    Value-for-money questions are searched as asked, with fewer hits; all others anchored to the conversation
    and in English. Equal searches are run once and joined back.
    """
    supplied = F.col("translation") if "translation" in queries.columns else F.lit(None).cast("string")
    asked = queries.withColumn("_anchored", anchored_query(F.col("text"), F.col("history")))
    asked = asked.withColumn("_value", tx.is_value_for_money(F.col("text"))).withColumn(
        "retrieval_query", F.when(F.col("_value"), F.col("text")).otherwise(
            tx.accepted_translation(F.col("_anchored"), supplied))).drop("_anchored")
    keyed = asked.withColumn("_search", tx.dedup_key(F.col("retrieval_query")))
    # The searches are read several times (vectors, terms, counts): cut their lineage once.
    shared_folder(queries.sparkSession)
    distinct = keyed.groupBy("_search", "_value").agg(F.min("query_id").alias("search_id"), F.min_by(
        "retrieval_query", "query_id").alias("text")).checkpoint()

    searches = distinct.select(F.col("search_id").alias("query_id"), "text",
                               F.when(F.col("_value"), min(VALUE_HITS, k)).otherwise(k).alias("hit_limit"))
    hits = with_chunk_details(hybrid_hits(searches, chunks, embed, k, stems=stems, stem=stem), chunks, sources)
    grouped = hits_per_query(hits).withColumnRenamed("query_id", "search_id")
    found = distinct.drop("text").join(grouped, "search_id", "left")
    rows = keyed.join(found, ["_search", "_value"]).fillna(0, ["hit_count"])
    hit_list = F.coalesce("hits", F.array().cast(grouped.schema["hits"].dataType))
    rows = rows.withColumn("hits", hit_list).withColumn(
        "weak", is_weak(F.col("best_similarity"), F.col("best_lexical"), F.col("hit_count"))).withColumn(
        "route", route(F.col("text"), F.col("weak"), F.col("hit_count")))
    prompt = (F.when(F.col("route") == "generate", grounded_prompt(F.col("history"), F.col("hits"), F.col("text")))
              .when(F.col("route") == "value_for_money", value_prompt(F.col("hits"), F.col("text")))
              .when(F.col("route") == "clarify", clarify_prompt(F.col("history"), F.col("hits"), F.col("text"))))
    # where the model has nothing to ask back, the question is answered like any other
    fallback = F.when(F.col("route") == "clarify", grounded_prompt(F.col("history"), F.col("hits"), F.col("text")))
    return rows.select(
        "query_id", "text", "retrieval_query", "route", "weak", "hits", prompt.alias("prompt"), fallback.alias("fallback_prompt"),
        F.when(F.col("route") == "clarify", snippets(F.col("hits"))).alias("snippets"),
        F.when(F.col("route") == "no_answer", tx.no_answer_text(F.col("text"))).alias("canned"))
