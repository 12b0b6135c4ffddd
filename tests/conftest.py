import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("BENCH_CPUS", "4")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import build_session, ship_package

    session = build_session("tests", **{"spark.driver.memory": "4g"})
    ship_package(session)
    yield session
    session.stop()
