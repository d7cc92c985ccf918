import pytest


@pytest.fixture(scope="session")
def spark():
    from siteweave.session import local_session

    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
