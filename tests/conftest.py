import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from statloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session(4, "statloom-tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(folder)})
    yield session
    session.stop()
