"""Connected components of a graph of links, in rounds of joins and checkpoints."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baraza.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``id, class_id``: the smallest id reachable from each end of ``links`` (``a``, ``b``, both never null).

    Each round takes the smallest label among neighbours and then the label's own label, so a chain shrinks by more than
    half. A hub is only ever a join key, never one task's group: its links are counted before they are shuffled and a
    join may split them. Nothing but the number of changes reaches the driver.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("class_id")))
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), "class_id"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class_id").alias("near")))
        nearer = labels.join(near, "id").select("id", "class_id", F.least("class_id", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("class_id").alias("far"))
        after = cut(nearer.join(jump, "to").select("id", F.col("class_id").alias("was"), F.least("to", "far").alias("class_id")))
        if after.where("was <> class_id").isEmpty():
            return after.select("id", "class_id")
        labels = after.select("id", "class_id")
