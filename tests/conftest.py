from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paperloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate an expression of column ``x`` for one value."""

    def evaluate(build, value, kind="string"):
        from pyspark.sql import functions as F

        return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("r")).first()["r"]

    return evaluate
