"""A table that a stream changes batch by batch, and that readers see only in whole versions.

Each micro-batch writes its changed rows under its own number and is then entered in a manifest, by one rename. A reader takes the
base and the entered versions after it, and of each key the row of the latest version; what a running batch has written so
far is not entered and so not seen. A batch that comes again finds its number entered and changes nothing. ``compact`` folds what is
entered into a new base, so the number of versions a reader merges stays bounded.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baraza.session import run_folder
from baraza.sources.manifest import Manifest
from baraza.streaming.running import run_batches

VERSION, GONE = "_version", "_gone"


class Versioned:
    """Rows of ``schema``, one for each value of ``keys``, in a folder of base and versions."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str], compact_every: int = 16):
        self.spark, self.folder, self.keys, self.compact_every = spark, folder, list(keys), compact_every
        self.columns = schema.fieldNames()
        self.stored = T.StructType([T.StructField(f.name, f.dataType) for f in schema] + [
            T.StructField(GONE, T.BooleanType()), T.StructField(VERSION, T.LongType())])
        self.manifest = Manifest(spark, folder)

    def _parts(self) -> tuple[int, list[int]]:
        """The base's version (-1 for none) and the versions after it."""
        names = self.manifest.entries()
        base = max((int(n[5:]) for n in names if n.startswith("base-")), default=-1)
        return base, sorted(int(n[8:]) for n in names if n.startswith("changes-") and int(n[8:]) > base)

    def commit(self, version: int, changes: DataFrame) -> None:
        """Enter ``changes`` (at most one row for each key) as ``version``; rows with a true ``_gone`` remove their key."""
        base, later = self._parts()
        if version <= base or version in later:
            return
        gone = F.col(GONE) if GONE in changes.columns else F.lit(False)
        rows = changes.select(*self.columns, gone.alias(GONE), F.lit(version).cast("long").alias(VERSION))
        rows.write.mode("overwrite").parquet(f"{self.folder}/changes-{version}")
        self.manifest.enter(f"changes-{version}", {"version": version})
        if len(later) + 1 >= self.compact_every:
            self.compact()

    def _latest(self) -> DataFrame:
        base, later = self._parts()
        paths = [f"{self.folder}/base-{base}"] * (base >= 0) + [f"{self.folder}/changes-{v}" for v in later]
        if not paths:
            return self.spark.createDataFrame([], self.stored)
        rows = self.spark.read.schema(self.stored).parquet(*paths)
        if len(paths) == 1:  # one version holds a key once
            return rows.where(~F.col(GONE))
        kept = rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in self.keys]).agg(F.max_by(F.struct(*self.stored.fieldNames()), VERSION).alias("_row"))
        return kept.select("_row.*").where(~F.col(GONE))

    def read(self) -> DataFrame:
        """The table as of the last version entered."""
        return self._latest().select(*self.columns)

    def compact(self) -> None:
        _, later = self._parts()
        if later:
            self._latest().write.mode("overwrite").parquet(f"{self.folder}/base-{later[-1]}")
            self.manifest.enter(f"base-{later[-1]}", {"version": later[-1]})


def run_versioned(stream: DataFrame, keys: Sequence[str], label: str, *, folder: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run an aggregation in update mode over everything available now; its result for every key, as of the last version.

    A micro-batch reads and writes what it changes; the running values of all keys stay in the state store.
    """
    folder = folder or run_folder(stream.sparkSession, label)
    table = Versioned(stream.sparkSession, folder, stream.schema, keys)
    run_batches(stream, checkpoint or f"{folder}/checkpoint", lambda batch, number: table.commit(number, batch), "update")
    return table.read()
