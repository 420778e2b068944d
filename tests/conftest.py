"""One small Spark session for all tests."""

import os

import pytest
from pyspark.sql import SparkSession

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    return SMALL


def same_rows(got, want):
    """Both as sorted texts, so that nulls compare."""
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
