import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stockroom.session import session

    s = session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__driver__bindAddress="127.0.0.1", spark__driver__host="127.0.0.1")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF
