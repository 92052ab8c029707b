import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from provena.session import build_session

    s = build_session("tests", cores="8", partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
