"""One query for each operator over its whole table, and SQL where it can express the result."""

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baraza.llm import bagminhash, chat, collocations, containment, density, language, licences, negatives, private, recipes, relative_lz, rollup, unigram
from baraza.llm.common import read, stored
from baraza.session import run_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return register


@query("""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op2_exact_dedup(spark, sf):
    return recipes.exact_groups(read(spark, sf, "documents"))


@query(r"""
    WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda w: w <> '') AS words FROM documents),
    windows AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 19], ' ')) AS held
                FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM split WHERE len(words) >= 20)),
    later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY held ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1),
    gone AS (SELECT DISTINCT doc_id, i + d AS i FROM later, (SELECT unnest(range(0, 20)) AS d)),
    listed AS (SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM split)),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM listed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(text, '')) AS kept_sha256
    FROM split LEFT JOIN kept USING (doc_id)
""")
def op4_substring_dedup(spark, sf):
    return relative_lz.without_repeats(read(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


PIECES = "piece_bpe_32k.model"


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; ``BARAZA_TOKENIZERS`` names the folder."""
    return os.path.join(os.environ.get("BARAZA_TOKENIZERS", "/opt/tokenizers"), name)


@query()
def op9_sentencepiece(spark, sf):
    """Ids of every text and whether they decode to it; not expressible in SQL, tested against a plain Viterbi."""
    pieces = unigram.Pieces.load(tokenizer_file(PIECES))
    docs = read(spark, sf, "documents").select("doc_id", "text")
    back = unigram.decode(unigram.encode(docs, pieces), pieces)
    return back.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), unigram.count_fallback(pieces).cast("long").alias("n_bytes"),
                       F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"), "token_ids")


@query()
def op8_language_id(spark, sf):
    """Not expressible in SQL; tested for held-out accuracy and against forward-backward over all paths."""
    return language.identify(read(spark, sf, "documents"))


@query(r"""
    WITH RECURSIVE split AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\x0C\r]+'), lambda w: w <> '') AS words FROM documents),
    shingled AS (SELECT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS shingle
                 FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS i FROM split)),
    bag AS (SELECT doc_id, shingle, count(*) AS n FROM shingled GROUP BY ALL),
    total AS (SELECT doc_id, sum(n) AS n FROM bag GROUP BY doc_id),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS n FROM bag x JOIN bag y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared s JOIN total t ON t.doc_id = a JOIN total u ON u.doc_id = b WHERE s.n >= 0.8 * (t.n + u.n - s.n)),
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
    classes AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id)
    SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM classes
""")
def op7_minhash_near_dedup(spark, sf):
    return bagminhash.near_classes(read(spark, sf, "documents"))


@query()
def op10_html_extraction(spark, sf):
    """Not expressible in SQL; tested on pages with known articles."""
    return density.extract(read(spark, sf, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query(r"""
    WITH texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
    split AS (SELECT kind, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM texts),
    shingled AS (SELECT DISTINCT kind, id, array_to_string(words[i:i + 4], ' ') AS shingle
                 FROM (SELECT kind, id, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5)),
    sizes AS (SELECT id, count(*) AS n FROM shingled WHERE kind = 'i' GROUP BY id),
    shared AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM shingled d JOIN shingled i USING (shingle)
               WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
    short AS (SELECT id AS item_id, len(words) AS m, array_to_string(words, ' ') AS phrase FROM split WHERE kind = 'i' AND len(words) BETWEEN 1 AND 4),
    grams AS (SELECT DISTINCT id AS doc_id, array_to_string(words[i:i + m - 1], ' ') AS phrase
              FROM (SELECT id, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM split, (SELECT DISTINCT m FROM short) WHERE kind = 'd' AND len(words) >= m))
    SELECT doc_id, item_id, n_shared, n AS n_item, n_shared / n AS containment FROM shared JOIN sizes ON id = item_id WHERE n_shared >= 0.8 * n
    UNION ALL SELECT DISTINCT doc_id, item_id, 1, 1, 1.0 FROM grams JOIN short USING (phrase)
""")
def op5_decontamination(spark, sf):
    return containment.contained(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query()
def op1_license_scan(spark, sf):
    """Weights are natural logarithms summed in template order; tested against a plain scan of every text."""
    return licences.licences(read(spark, sf, "documents"))


@query()
def op3_personal_data(spark, sf):
    """Reliabilities come from iterated estimates; tested against plain patterns and planted secrets."""
    return private.spans(read(spark, sf, "documents"))


RANKS = "byte_bpe_50k.tiktoken"
#: The pattern that belongs to the rank file, as its description gives it.
RANKS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@query()
def op6_token_counts(spark, sf):
    """All documents inserted, toxic ones deleted, accepted ones revised by an end mark; the deletes are delivered twice.

    Not expressible in SQL; tested against the tokenizer on single texts.
    """
    with open(tokenizer_file(RANKS), "rb") as ranks:
        ranks = ranks.read()
    version = f"byte_bpe_50k-{rollup.tokenizer_version(RANKS_PATTERN, ranks)}"
    counts = stored(rollup.counted(read(spark, sf, "documents"), version, RANKS_PATTERN, ranks), "counts")
    labels = read(spark, sf, "labels")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    accepted = labels.where("quality = 1").select("doc_id").distinct().join(toxic, "doc_id", "left_anti")
    totals = rollup.Rollup(spark, run_folder(spark, "totals"))
    totals.commit("load", rollup.inserts(counts))
    gone = rollup.deletes(counts.join(toxic, "doc_id", "left_semi"))
    totals.commit("moderation", gone)
    totals.commit("end marks", rollup.revisions(counts.join(accepted, "doc_id", "left_semi"), F.col("n_tokens") + 1))
    totals.commit("moderation", gone)
    return totals.totals()


@query(r"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
    split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS words FROM pieces),
    sized AS (SELECT lang, words, unnest(range(1, least(len(words), 4) + 1)) AS size FROM split),
    runs AS (SELECT lang, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM sized),
    counts AS (SELECT lang, array_to_string(words[i:i + size - 1], ' ') AS phrase, size, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 30),
    totals AS (SELECT lang, sum(len(words)) AS n FROM split GROUP BY lang),
    wide AS (SELECT *, string_split(phrase, ' ') AS words FROM counts),
    cuts AS (SELECT *, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:size], ' ') AS tail
             FROM (SELECT *, unnest(range(1, size)) AS k FROM wide WHERE size > 1)),
    scored AS (SELECT c.lang, c.phrase, c.a, h.a AS l, t.a AS r, k, CAST(CAST(2000000 AS HUGEINT) * c.a // (h.a + t.a) AS BIGINT) AS score
               FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = head JOIN counts t ON t.lang = c.lang AND t.phrase = tail),
    weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS longer
               FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM wide WHERE size > 2)) GROUP BY ALL),
    kept AS (SELECT w.* FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80)
    SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
    FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= 2000
""")
def op11_phrase_collocations(spark, sf):
    return collocations.collocations(read(spark, sf, "documents"))


@query("""
    WITH taken AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
              FROM taken a JOIN taken b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER best <= 3
""")
def op12_hard_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


@query()
def op13_chat_formatting(spark, sf):
    """Window lengths depend on the tokenizer; tested against windows built turn by turn and digests of the turns themselves."""
    with open(tokenizer_file(RANKS), "rb") as ranks:
        ranks = ranks.read()
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(added)
    return chat.read_back(chat.format_windows(turns, "byte_bpe_50k", RANKS_PATTERN, ranks))
