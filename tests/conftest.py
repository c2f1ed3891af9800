import pytest

from larder.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", memory="8g", partitions=4)
    yield session
    session.stop()
