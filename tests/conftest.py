import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from terrier.session import local_session, prepare


@pytest.fixture(scope="session")
def spark():
    session = prepare(local_session("4", partitions=4, memory="4g"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
