"""One local session for all tests."""

from __future__ import annotations

import pytest

from orrery.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    s = get_session("tests", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.local.dir": str(root), "spark.sql.warehouse.dir": str(root / "warehouse")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
