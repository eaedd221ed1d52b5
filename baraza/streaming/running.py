"""Sources and runs of bounded streams."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from baraza.session import run_folder

_PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"
ALL_BATCHES = 1_000_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state beyond memory: needed by the stateful processors, advisable for every stream here."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 64,
                pattern: str | None = None) -> DataFrame:
    """Parquet files as a stream. ``files_per_trigger`` bounds a micro-batch and with it the rows a key can bring at once."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def run_to_folder(stream: DataFrame, label: str) -> str:
    """Run an append-mode stream over everything available now; the folder with its ``table`` and its ``checkpoint``.

    A bounded run that would lose rows behind its watermark is an error, not a shorter result.
    """
    spark = stream.sparkSession
    folder = run_folder(spark, label)
    spark.conf.set(_PROGRESS, str(ALL_BATCHES))  # what is summed below must not forget the first batches
    started = (stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
               .option("checkpointLocation", f"{folder}/checkpoint").start(f"{folder}/table"))
    started.awaitTermination()
    lost = sum(int(s["numRowsDroppedByWatermark"]) for p in started.recentProgress for s in p["stateOperators"])
    if lost:
        raise RuntimeError(f"{label}: {lost} rows came behind the watermark; allow more lateness or decide by key (streaming.keyed)")
    return folder


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """``run_to_folder`` as the table it wrote."""
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{run_to_folder(stream, label)}/table")


def read_state(spark: SparkSession, checkpoint: str, variable: str | None = None) -> DataFrame:
    """What a stateful run has left in its state (or in the state variable ``variable``): ``key`` and value of every key it still holds."""
    reader = spark.read.format("statestore").option("path", checkpoint)
    return (reader.option("stateVarName", variable) if variable else reader).load()


def stream_again(stream: DataFrame, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """What ``stream`` has written to ``folder`` as the stream of a next stage."""
    return read_stream(stream.sparkSession, f"{folder}/table", stream.schema, files_per_trigger)


def run_latest(stream: DataFrame, label: str) -> DataFrame:
    """Run a complete-mode aggregation over everything available now and return its final result table."""
    spark = stream.sparkSession
    folder = run_folder(spark, label)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table")

    run_batches(stream, f"{folder}/checkpoint", replace, "complete")
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    started = (stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
               .foreachBatch(handle).start())
    started.awaitTermination()
