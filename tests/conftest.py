import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import build_session

    session = build_session("tests", **{"spark.sql.shuffle.partitions": "4", "spark.sql.autoBroadcastJoinThreshold": "256k"})
    yield session
    session.stop()
