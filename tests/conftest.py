import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from moodlark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("moodlark-tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture
def posts_of(spark):
    """A posts DataFrame from (id, source, target, tweet) tuples."""

    def build(rows):
        return spark.createDataFrame(rows, "id long, source string, target string, tweet string")

    return build
