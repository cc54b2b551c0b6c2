import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cfgveil.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "cfgveil-tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """Rows (path, content) from a dict or a list of texts."""

    def make(rows):
        pairs = list(rows.items()) if isinstance(rows, dict) else [(f"/c/f{i}.conf", t) for i, t in enumerate(rows)]
        return spark.createDataFrame(pairs, "path string, content string")

    return make
