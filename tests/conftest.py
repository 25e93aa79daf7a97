import math
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def blobs(spark):
    """Three separated groups of 100 points, from hashed offsets."""
    return spark.range(300).selectExpr(
        "id AS point_id",
        "id % 3 AS label",
        "(id % 3) * 10D + pmod(hash(id, 1), 1000) / 1000D AS x0",
        "pmod((id % 3) * 7, 5) * 4D + pmod(hash(id, 2), 1000) / 1000D AS x1",
    )


@pytest.fixture(scope="session")
def pop4(spark):
    rows = [
        (0, 0, 0.0, 0.0, 1.0, 1.0),
        (0, 1, 1.0, 0.0, 0.5, 1.0),
        (0, 2, 0.0, 2.0, 1.0, 0.5),
        (0, 3, 5.0, 5.0, 2.0, 2.0),
    ]
    return spark.createDataFrame(
        rows, "run_id bigint, id bigint, c0 double, c1 double, s0 double, s1 double"
    )


@pytest.fixture
def close():
    def check(a, b, tol=1e-9):
        return math.isclose(a, b, rel_tol=tol, abs_tol=tol)

    return check
