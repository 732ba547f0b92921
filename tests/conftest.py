import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cladetally.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", "8", 4)


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over a one-row frame with column `x`."""
    def value(value, make):
        return spark.createDataFrame([(value,)], "x string").select(make("x").alias("y")).first()["y"]
    return value
