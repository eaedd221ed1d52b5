"""Vector columns: unit length, similarity, and the text-to-vector hook."""

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unit_vector(vector: Column, floor: float = 1e-12) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    # The one-element array binds the norm once instead of once per component.
    return F.flatten(F.transform(F.array(F.greatest(F.sqrt(squares), F.lit(floor))),
                                 lambda n: F.transform(vector, lambda x: x.cast("double") / n)))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def hashed_word_vectors(df: DataFrame, terms: str, out: str, dimensions: int = 384) -> DataFrame:
    """A deterministic stand-in for a text model: hashed term counts at unit length, all in the JVM."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    counted = HashingTF(inputCol=terms, outputCol="_tf", numFeatures=dimensions).transform(df)
    unit = F.transform(unit_vector(vector_to_array("_tf")), lambda x: x.cast("float"))
    return counted.withColumn(out, unit).drop("_tf")


def embed_in_batches(df: DataFrame, text: str, out: str,
                     embed: Callable[[list[str]], "list[list[float]]"], batch_size: int = 32) -> DataFrame:
    """Append unit vectors that the caller's batch function ``embed`` computes, ``batch_size`` texts a call.

    Spark owns partitioning; the function sees one small batch at a time, so memory stays bounded.
    """
    import numpy as np
    import pandas as pd

    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator["pd.DataFrame"]) -> Iterator["pd.DataFrame"]:
        for frame in frames:
            vectors = []
            texts = frame[text].tolist()
            for start in range(0, len(texts), batch_size):
                block = np.asarray(embed(texts[start:start + batch_size]), dtype="float32")
                norms = np.linalg.norm(block, axis=1, keepdims=True)
                vectors.extend(block / np.maximum(norms, 1e-12))
            yield frame.assign(**{out: vectors})

    return df.mapInPandas(run, schema)
