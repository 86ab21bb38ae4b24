import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__ as entry
    from lexigrid.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    entry._ship(session)
    yield session
    session.stop()
