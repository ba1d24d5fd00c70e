import pytest

from netweave.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
