import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from scholia.session import build_session, ship_package

    session = build_session("tests", 4, **{"spark__sql__shuffle__partitions": "4", "spark__driver__memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()
