import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from metrospan.session import local_session
    session = local_session(partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
