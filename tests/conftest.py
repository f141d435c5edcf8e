import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quire.session import get_session

    wh = tempfile.mkdtemp(prefix="quire-wh-")
    s = get_session(
        "local[4]",
        app="quire-tests",
        shuffle_partitions=8,
        extra={"spark.sql.warehouse.dir": wh, "spark.driver.memory": "4g"},
    )
    yield s
    s.stop()
