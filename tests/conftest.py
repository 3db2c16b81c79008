"""One session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from spanveil.session import local_session

    s = local_session(int(os.environ.get("TEST_CPUS", "8")), "tests")
    s.sparkContext.setLogLevel("ERROR")
    return s
