import os

import pytest

from checks.compare import connect
from usagelake.session import local_session

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(8, memory="8g", app="tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="session")
def lake(spark, sf_dir):
    from usagelake.lake import Lake

    return Lake(spark, sf_dir)
