"""One small session for all tests, with a checkpoint folder of its own."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lectern.session import session

    conf = {"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.driver.memory": "4g"}
    made = session("local[4]", "tests", **conf)
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
