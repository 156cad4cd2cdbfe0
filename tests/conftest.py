import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# The ten edges of the sample list, in file order.
SAMPLE = [(2, 1), (2, 3), (2, 5), (2, 6), (3, 1), (3, 4), (3, 6), (4, 2), (5, 3), (3, 3)]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample(spark):
    from nodeloom.operators.edges import clean_edges

    rows = [(s, d, float(n + 1)) for n, (s, d) in enumerate(SAMPLE)]
    return clean_edges(spark.createDataFrame(rows, "src bigint, dst bigint, weight double")).cache()


@pytest.fixture(scope="session")
def graph(spark):
    """Make a cleaned edge table from pairs."""
    from nodeloom.operators.edges import clean_edges

    return lambda pairs: clean_edges(spark.createDataFrame(pairs, "src bigint, dst bigint"))


def as_map(df, key="nodeid"):
    """Rows as a dict of key to the remaining value, or tuple of values."""
    rest = [c for c in df.columns if c != key]
    return {r[key]: (r[rest[0]] if len(rest) == 1 else tuple(r[c] for c in rest)) for r in df.collect()}
