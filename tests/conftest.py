import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from linkloom.session import local_session

    session = local_session("8", partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture()
def edges(spark):
    """Small graph with two components: a triangle with a tail, and one pair."""
    rows = [("1", "2"), ("2", "3"), ("1", "3"), ("3", "4"), ("8", "9")]
    return spark.createDataFrame(rows, "src string, dst string")
