import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
# workers import the package from here, wherever the tests are started
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from quaybook.session import local_session

    session = local_session(4, partitions=4, memory="3g", app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
