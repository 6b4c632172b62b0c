import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from notewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 4)


@pytest.fixture(scope="session")
def column(spark):
    """Evaluate one column function over a list of texts, in order."""

    def run(values, use, kind="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
        return [r["y"] for r in rows.select("i", use("x").alias("y")).orderBy("i").collect()]

    return run
