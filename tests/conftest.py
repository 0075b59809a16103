import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cellgrad.session import build_session
    s = build_session("local[4]", app="cellgrad-tests", shuffle_partitions=4, driver_memory="4g")
    yield s
    s.stop()
