import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# Columns made while test modules are imported need a running session.
SESSION = (
    SparkSession.builder.master("local[8]")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.driver.memory", "8g")
    .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pageloom-tests-"))
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def column(spark):
    """Values of a column expression over rows of strings named a, b, …"""

    def run(expression, *rows):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        schema = ", ".join(f"{n} string" for n in "abcd"[: len(rows[0])]) + ", n int"
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
        return [r[0] for r in df.select(expression.alias("v"), "n").orderBy("n").collect()]

    return run
