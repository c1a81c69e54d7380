"""Every registered query against its oracle SQL."""

import pytest

import __spark_entry__ as entry
import oracle_queries
import run_queries
from jetlake.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    return run_queries.connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(oracle_queries.all_queries()) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    text, ok = run_queries.compare(spark, duck, name, SF_DIR)
    assert ok, text


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) > 100 and all(r.n_jets > 0 and r.hardest_pt >= r.mean_pt >= 5.0 for r in rows)
