import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from siftloom.session import build_session  # noqa: E402
from siftloom.streaming.runs import ROCKSDB  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "siftloom-tests", "local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", **ROCKSDB},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named strings."""

    def evaluate(expression, **values):
        names = list(values) or ["_"]
        schema = ", ".join(f"{n} string" for n in names)
        row = [values.get(n) for n in names]
        return spark.createDataFrame([tuple(row)], schema).select(expression.alias("v")).collect()[0].v

    return evaluate
