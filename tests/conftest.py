import os

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

import pytest
from verify import session


@pytest.fixture(scope="session")
def spark():
    s = session(os.environ.get("TEST_CPUS", "4"))
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


def rows(df):
    """Rows as tuples, sorted by their text."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
