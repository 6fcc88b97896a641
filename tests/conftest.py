"""One small session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import local_session

    home = tmp_path_factory.mktemp("spark")
    session = local_session(4, "6g", 4, **{"spark.sql.warehouse.dir": str(home / "warehouse"), "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setCheckpointDir(str(home / "checkpoints"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables here")
    return str(folder)
