import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from orrery.session import build_session, ship

    s = build_session("local[8]", 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", "4")
    ship(s)
    yield s
    s.stop()
