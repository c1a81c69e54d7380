import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import run_queries  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return run_queries.session()


@pytest.fixture(scope="session")
def make_events(spark):
    """Event rows from lists of (px, py, pz, e)."""
    def make(events):
        rows = [(n, [tuple(map(float, p)) for p in particles]) for n, particles in enumerate(events)]
        return spark.createDataFrame(
            rows, "event bigint, particles array<struct<px:double,py:double,pz:double,e:double>>")
    return make
