"""Token counts as additive totals by source, language and tokenizer version, kept up by signed batches.

A batch of signed rows - inserts, deletes, and revised counts as one of each - is summed by key and written once under the
batch's id; a batch that comes again is ignored, a half-written one is written anew. Totals are the sum of what is
committed. ``compact`` folds committed batches into a new base, which remembers the ids it holds.

* A null text has no tokens. Null sources and languages are keys of their own. Repeated rows count as often as they come.
* Keys whose documents and tokens are both back at zero are not reported.
* An empty batch is committed, and changes nothing; other columns of the documents are ignored.
"""

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
_ENCODINGS: dict = {}


def tokenizer_version(pattern: str, ranks: bytes) -> str:
    """What tells two tokenizers of one name apart: a digest of pattern and ranks."""
    return hashlib.sha256(pattern.encode() + b"\0" + ranks).hexdigest()[:12]


def _encoding(name: str, pattern: str, ranks: bytes):
    """One encoding for each worker process and content, whatever the name."""
    key = hash((pattern, ranks))
    if key not in _ENCODINGS:
        import tiktoken

        parsed = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=parsed, special_tokens={})
    return _ENCODINGS[key]


def counted(docs: DataFrame, tokenizer: str, pattern: str, ranks: bytes) -> DataFrame:
    """``doc_id, source, lang, tokenizer, n_tokens``. ``ranks``: the content of a rank file, read once on the driver."""
    kinds = dict(docs.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer, pattern, ranks)
        for batch in batches:
            n = pa.array([len(encoding.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "source", "lang")] + [n], names=["doc_id", "source", "lang", "n_tokens"])

    found = docs.select("doc_id", "source", "lang", "text").mapInArrow(count, f"doc_id {kinds['doc_id']}, source string, lang string, n_tokens long")
    return found.withColumn("tokenizer", F.lit(tokenizer)).select("doc_id", *KEYS, "n_tokens")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(F.lit(1).alias("sign"), *KEYS, "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(F.lit(-1).alias("sign"), *KEYS, "n_tokens")


def revisions(counts: DataFrame, n_tokens) -> DataFrame:
    """Rows that take back the old counts and enter the new ones."""
    return deletes(counts).union(inserts(counts.withColumn("n_tokens", n_tokens)))


class Rollup:
    """Totals in ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _there(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _children(self, kind: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}-*/_SUCCESS")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(f.getPath().getParent().getName().removeprefix(f"{kind}-") for f in found or [])

    def _base(self) -> str | None:
        bases = self._children("base")
        return max(bases, key=int) if bases else None

    def _folded(self) -> set[str]:
        base = self._base()
        return set() if base is None else {r[0] for r in self.spark.read.parquet(f"{self.folder}/folded-{base}").collect()}

    def commit(self, batch_id: str, signed: DataFrame) -> bool:
        """Whether the batch was new. ``signed``: sign, source, lang, tokenizer, n_tokens."""
        name = batch_id.encode().hex()  # any id is a safe file name
        path = f"{self.folder}/batch-{name}"
        if self._there(path) or name in self._folded():
            return False
        summed = signed.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        summed.write.mode("overwrite").parquet(path)
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens``."""
        folded = self._folded()
        return self._sum(self._base(), [b for b in self._children("batch") if b not in folded])

    def _sum(self, base: str | None, batches: list[str]) -> DataFrame:
        parts = [f"{self.folder}/base-{base}"] if base is not None else []
        parts += [f"{self.folder}/batch-{b}" for b in batches]
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        rows = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold the batches committed by now into a new base; it holds exactly those whose ids are listed.

        The list of ids is written first; the base counts once it is complete. A batch committed meanwhile is in neither.
        """
        base, before = self._base(), self._folded()
        added = [b for b in self._children("batch") if b not in before]
        number = str(int(base or 0) + 1)
        totals = self._sum(base, added)
        self.spark.createDataFrame([(b,) for b in sorted(before | set(added))], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/folded-{number}")
        totals.write.mode("overwrite").parquet(f"{self.folder}/base-{number}")
