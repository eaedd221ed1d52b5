"""What several operators share: table access, reliable cuts of lineage, vectorised hashing of Arrow strings."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baraza.session import run_folder, shared_folder

SALTS = 16
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a Parquet table in the cluster's shared folder."""
    folder = run_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def in_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` over batches of about ``BATCH_BYTES`` (one longer row makes its own), so long texts do not fill a worker.

    The bound is the session's setting, lowered unless it is lower already.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def salted(df: DataFrame, key) -> DataFrame:
    """``df`` with a column ``salt`` that deals out the rows of one hot key by ``key``."""
    return df.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))


def all_salts(df: DataFrame) -> DataFrame:
    """Each row once for each salt: the small side of a salted join."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the ``n + 1`` offsets of its rows in them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = (np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, wide)).astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0]:at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]), dtype=np.uint64)[:n]


class Rolling:
    """Hashes of any spans of a sequence of 64-bit values, from one running sum."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, values: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(self.BASE, len(values)), dtype=np.uint64)])
        self.shift = powers(self.INVERSE, len(values) + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of ``values[start:end]`` for each pair; equal spans have equal hashes wherever they stand."""
        return mix((self.sums[end] - self.sums[start]) * self.shift[start] + (end - start).astype(np.uint64))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def byte_hashes(data: np.ndarray) -> Rolling:
    return Rolling(_BYTE[data])


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross rows: their starts, their ends, and per row the first run's number."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows of at most ``most`` bytes, or of one longer row: bounds the memory of vectorised work."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last
