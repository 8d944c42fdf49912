"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reedmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4)


@pytest.fixture
def column(spark):
    """Evaluates a Column builder over strings: column(f, ["a", None])."""
    from pyspark.sql import functions as F

    def run(f, values, kind="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).collect()
        return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]

    return run
