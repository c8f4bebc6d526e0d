import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from glossa.runtime import session

    s = session("tests", "4", spark__sql__shuffle__partitions="4", spark__default__parallelism="4")
    yield s
    s.stop()
