"""Benchmark decontamination: size-partitioned MinHash containment search, verified shingle by shingle.

A test item of ``n`` distinct shingles is partitioned by ``n``. Of a document that holds a share ``t`` of them, at most
``n - ceil(t * n)`` can be missing, so one of the item's ``n - ceil(t * n) + 1`` smallest shingle hashes is in the document:
this bottom sketch, whose size follows the item's, is all that is indexed, and no containment is lost. Each partition
brings the largest hash in its sketches; a document looks up only hashes up to that of the partitions it is large enough
to contain. Documents that meet a sketch are verified on the shingles themselves.

All work is DataFrame expressions. Items are joined as a table; they are broadcast only where Spark finds their written
table below its own threshold, and otherwise shuffled by shingle, where a hot shingle may be split.

* Words are lower-cased runs of letters and digits. An item with fewer words than a shingle is one shingle of its own length, looked up
  among the documents' runs of that length (only lengths that occur among the items are made). A null or wordless item is never found.
* Rows with a null ``doc_id`` or ``item_id`` can't be named in a pair and give none. Of rows that repeat an id each text is
  compared on its own, and the best is reported.
* Columns besides the id and ``text`` are ignored; empty tables give an empty result.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baraza.llm.common import stored
from baraza.llm.text import places, split_words

BETWEEN = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return split_words(F.lower(text), BETWEEN)


def _split(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the words ``w`` of ``text``, split once: what a generator makes is not computed again in a later filter or function."""
    parts = F.split(F.coalesce(F.lower("text"), F.lit("")), BETWEEN)
    return texts.select(*keep, F.explode(F.array(F.filter(parts, lambda word: word != ""))).alias("w"))


def _shingles(words: Column, n: int) -> Column:
    return F.array_distinct(F.transform(places(F.size(words) - n + 1), lambda i: F.concat_ws(" ", *[F.get(words, i + d) for d in range(n)])))


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, words: int = 5) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment``: the items of which a document holds ``threshold`` or more."""
    own = (items.where(F.col("item_id").isNotNull()).select("item_id", _words(F.col("text")).alias("w"))
           .select("item_id", _shingles(F.col("w"), words).alias("s")).where(F.size("s") > 0).distinct()
           .select("item_id", F.xxhash64("s").alias("item_row"), F.size("s").alias("n"), F.explode("s").alias("shingle")))
    hashed = F.xxhash64(*[F.get(F.split("shingle", " "), F.lit(d)) for d in range(words)])
    index = stored(own.withColumn("hash", hashed), "items")
    needed = F.ceil(F.lit(threshold) * F.col("n") - 1e-9)
    bottom = (index.groupBy("item_id", "item_row", "n").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))
              .select("n", F.explode(F.slice("hashes", F.lit(1), (F.col("n") - needed + 1).cast("int"))).alias("hash")))
    sketch = stored(bottom.withColumn("partition", F.floor(F.log2("n")).cast("int")), "sketch")
    bounds = sketch.groupBy("partition").agg(F.min("n").alias("least"), F.max("hash").alias("bound")).orderBy("partition").collect()  # one row per doubling of n

    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("row"))
    seen = _split(texts, "doc_id", "row").withColumn("size", F.size("w") - words + 1)
    bound = F.lit(None).cast("long")
    for b in bounds:
        bound = F.greatest(bound, F.when(F.col("size") >= threshold * b["least"] - 1e-9, F.lit(b["bound"])))
    looked = (seen.withColumn("bound", bound).where("bound IS NOT NULL")
              .select("doc_id", "row", "w", "bound", F.explode(places(F.col("size"))).alias("i"))
              .select("doc_id", "row", "bound", F.xxhash64(*[F.get("w", F.col("i") + d) for d in range(words)]).alias("hash"))
              .where("hash <= bound").drop("bound"))
    met = stored(looked.join(sketch.select("hash").distinct(), "hash", "left_semi").select("doc_id", "row").distinct(), "met")
    whole = (_split(texts.join(met, ["doc_id", "row"], "left_semi"), "doc_id", "row")
             .select("doc_id", "row", F.explode(_shingles(F.col("w"), words)).alias("shingle")))
    shared = whole.distinct().join(index, "shingle").groupBy("doc_id", "row", "item_id", "item_row", "n").agg(F.count("*").alias("n_shared"))
    found = shared.where(F.col("n_shared") >= F.lit(threshold) * F.col("n") - 1e-9)
    best = F.max(F.struct((F.col("n_shared") / F.col("n")).alias("containment"), "n_shared", F.col("n").cast("long").alias("n_item")))
    full = found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_shared", "b.n_item", "b.containment")
    short = _short(texts, items, words)
    # an id that stands for a short and a longer text is found once, by the share of the longer one if that is as good
    return full.union(short).groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("b")).select(
        "doc_id", "item_id", "b.n_shared", "b.n_item", "b.containment")


def _short(texts: DataFrame, items: DataFrame, words: int) -> DataFrame:
    """Pairs of documents and items of fewer words than a shingle: the item's words stand together in the document."""
    own = items.where(F.col("item_id").isNotNull()).select("item_id", _words(F.col("text")).alias("w")).where(F.size("w").between(1, words - 1))
    own = stored(own.select("item_id", F.size("w").alias("length"), F.concat_ws(" ", "w").alias("shingle")).distinct(), "short-items")
    lengths = [r.length for r in own.select("length").distinct().collect()]  # fewer than ``words``
    seen = _split(texts, "doc_id")
    runs = [seen.select("doc_id", F.explode(_shingles(F.col("w"), n)).alias("shingle")) for n in lengths]
    none = seen.select("doc_id", F.lit("").alias("shingle")).limit(0)
    found = reduce(DataFrame.union, runs, none).join(own.select("item_id", "shingle"), "shingle").select("doc_id", "item_id").distinct()
    return found.select("doc_id", "item_id", F.lit(1).cast("long").alias("n_shared"), F.lit(1).cast("long").alias("n_item"), F.lit(1.0).alias("containment"))


def without_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    return docs.join(contained(docs, items, **options).select("doc_id").distinct(), "doc_id", "left_anti")
