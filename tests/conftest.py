import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from simplexspark import get_session

    return get_session("tests", spark__default__parallelism="4")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
