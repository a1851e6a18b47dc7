import pytest

from eventrail.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
