import pytest

from quillspark.session import session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session("local[4]", 4, **{"spark.driver.memory": "6g"})


@pytest.fixture(scope="session")
def sf():
    return SF
