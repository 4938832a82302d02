import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from markerloom.session import local_session

    session = local_session(8, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def baskets(spark):
    """Turns ``{(id, label): items}`` into a baskets table."""

    def make(rows):
        data = [(sample, label, list(items)) for (sample, label), items in rows.items()]
        return spark.createDataFrame(data, "sample_id string, label string, items array<string>")

    return make
