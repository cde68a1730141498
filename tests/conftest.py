import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from creditlens import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


# Started on import: column expressions in test parameters need a session.
SESSION = build_session("creditlens-tests", "local[8]", **{
    "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "4g",
})
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
