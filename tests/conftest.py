"""One session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from docloom.session import session

    at = tmp_path_factory.mktemp("spark")
    s = session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(at / "shared"), "spark.local.dir": str(at / "local"),
        "spark.sql.warehouse.dir": str(at / "warehouse"), "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
