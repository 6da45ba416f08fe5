import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

import harness  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = harness.spark_session()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{harness.DATA}/sf0.001"


@pytest.fixture(scope="session")
def oracle(sf):
    return harness.oracle_connection(sf)
