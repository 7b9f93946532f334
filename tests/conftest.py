import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from churnscope.session import get_spark

    s = get_spark("local[4]", 4)
    yield s


@pytest.fixture(scope="session")
def duck_small():
    from churnscope.parity import duckdb_connection

    return duckdb_connection(SMALL)
