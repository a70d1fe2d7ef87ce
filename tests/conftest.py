import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gaugewatch.schemas import LONG  # noqa: E402
from gaugewatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(base / "shared"),
            "spark.sql.warehouse.dir": str(base / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def long_frame(spark):
    """Long table from (tag, minutes after the start, value)."""

    def make(rows, start=datetime(2024, 1, 1)):
        return spark.createDataFrame([(start + timedelta(minutes=m), tag, v) for tag, m, v in rows], LONG)

    return make


SF = "/root/testdata/sf0.001"
