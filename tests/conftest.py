import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from baraza.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate one column expression over given values: ``one(fn, value)`` or a list of values."""
    from pyspark.sql import functions as F

    def evaluate(fn, values, kind="string"):
        many = isinstance(values, list)
        rows = [(i, v) for i, v in enumerate(values if many else [values])]
        df = spark.createDataFrame(rows, f"i int, v {kind}")
        found = [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]
        return found if many else found[0]

    return evaluate
