import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cleanloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    def make(rows, schema, parts=1):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make


def values(df, column, by=None):
    rows = df.orderBy(by).collect() if by else df.collect()
    return [r[column] for r in rows]
