import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import session, ship

    s = session("local[4]", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.ui.explainMode", "simple")
    yield ship(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
