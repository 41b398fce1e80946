import pytest

from weftline.runtime import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", cpus="4", **{"spark.sql.shuffle.partitions": "3", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
