from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pricetrail.session import local_session

    session = local_session(8, "pricetrail-tests")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    yield session
    session.stop()
