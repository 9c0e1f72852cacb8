import pytest

from earshot.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.driver.memory": "8g"})
    yield session
    session.stop()
