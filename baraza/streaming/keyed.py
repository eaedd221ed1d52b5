"""Streams whose result for a key depends on all of the key's rows, in whatever order and files they arrive.

Arrived rows are kept in a table, dealt into buckets by key. Each micro-batch decides the buckets it touches anew, with the
batch operator, from everything that has arrived. So no row is ever too late, none is lost or counted twice, and the
result after the last batch is the batch result. The price is reading a touched bucket's history again, for rules whose
every decision hangs on the one before; where rows arrive in order and late ones may go, the stateful streams keep less, and
what can be kept up by running values is (``streaming.windows``, ``streaming.versioned``).

A batch writes its buckets beside the older ones and is then entered in the manifest with their numbers; a reader takes each bucket
from the last batch entered that decided it, so it never sees one missing or half written.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baraza.session import run_folder
from baraza.sources.manifest import Manifest
from baraza.streaming.running import run_batches

BUCKET, ARRIVAL = "run_bucket", "run_arrival"


def _latest(rows: DataFrame, identity: list[str]) -> DataFrame:
    """Of the rows of one identity the one that arrived last, of those of one batch the largest."""
    row = F.struct(*[c for c in rows.columns if c != ARRIVAL])
    return rows.groupBy(*[F.col(c).alias(f"_{c}") for c in identity]).agg(F.max_by(row, F.struct(F.col(ARRIVAL), row)).alias("row")).select("row.*")


def run_keyed(stream: DataFrame, keys: list[str], decide: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, *,
              identity: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """Run over everything available now; the table ``decide`` gives for all rows that have ever arrived in ``folder``.

    ``decide`` treats each value of ``keys`` on its own and keeps these columns. With ``identity`` a row replaces earlier
    arrivals of the same identity. A repeated micro-batch overwrites its own rows. A key whose rows decide to nothing ends
    with no result. ``buckets`` must stay the same for a folder.
    """
    spark = stream.sparkSession
    result = decide(spark.createDataFrame([], stream.schema)).schema
    manifest = Manifest(spark, folder)

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        arrived = f"{folder}/arrived/{ARRIVAL}={number}"
        batch.withColumn(BUCKET, bucket).write.mode("overwrite").partitionBy(BUCKET).parquet(arrived)
        placed = T.StructType([*batch.schema.fields, T.StructField(ARRIVAL, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
        written = session.read.schema(placed).parquet(f"{folder}/arrived")
        touched = [r[0] for r in written.where(F.col(ARRIVAL) == number).select(BUCKET).distinct().collect()]  # at most ``buckets``
        rows = written.where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        rows = _latest(rows, identity) if identity else rows.drop(ARRIVAL)
        if str(number) not in manifest.entries():
            decide(rows).withColumn(BUCKET, bucket).write.mode("overwrite").parquet(f"{folder}/decided-{number}")
            manifest.enter(str(number), {"buckets": touched})

    run_batches(stream, checkpoint, handle)
    current: dict[int, int] = {}
    for number, entry in sorted(manifest.entries().items(), key=lambda x: int(x[0])):
        current |= dict.fromkeys(entry["buckets"], int(number))
    stored = T.StructType([*[T.StructField(f.name, f.dataType) for f in result], T.StructField(BUCKET, T.IntegerType())])
    found = spark.createDataFrame([], stored)
    for number in sorted(set(current.values())):
        own = [b for b, n in current.items() if n == number]
        found = found.unionByName(spark.read.schema(stored).parquet(f"{folder}/decided-{number}").where(F.col(BUCKET).isin(own)))
    return found.drop(BUCKET)


def decided(stream: DataFrame, keys: list[str], decide: Callable[[DataFrame], DataFrame], label: str, **options) -> DataFrame:
    """``run_keyed`` in a fresh folder."""
    folder = run_folder(stream.sparkSession, label)
    return run_keyed(stream, keys, decide, folder, f"{folder}/checkpoint", **options)
