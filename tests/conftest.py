import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tools.spark import session

    return session(partitions=4)


@pytest.fixture(scope="session")
def table(spark):
    """Small table from rows; the key is given as (batch, instance_id) in front of every row."""

    def make(rows, schema):
        return spark.createDataFrame(rows, "batch string, instance_id string, " + schema)

    return make


@pytest.fixture(scope="session")
def rows():
    """Rows without the key, sorted."""

    def take(df, *columns, key=False):
        picked = df.select(*(["batch", "instance_id"] if key else []), *columns)
        return sorted(tuple(r) for r in picked.collect())

    return take
