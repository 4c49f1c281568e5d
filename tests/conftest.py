import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from hazardry.session import local_session

    base = tmp_path_factory.mktemp("spark")
    session = local_session(4, "tests", spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir=str(base / "warehouse"), spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
