"""Shared fixtures: one local session and DuckDB over the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cadenza.session import get_session

    session = get_session("tests", "local[4]", spark__sql__shuffle__partitions=4, spark__driver__memory="4g", spark__driver__host="127.0.0.1", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
