import pytest

from sparkann.session import local_session, shared_dir, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus="4", partitions=4, memory="3g")
    ship(session)
    shared_dir(session)
    yield session
    session.stop()
