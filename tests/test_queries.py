"""Every query against its SQL on DuckDB, and the registry's promises."""

import os
import time

import pytest
from harness import compare, connect

from marketgrain.registry import ORACLE_SQL, QUERIES

os.environ["TZ"] = "UTC"
time.tzset()


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


def distinct():
    """Names that share a function with an earlier one are left out: the same query runs once."""
    seen = {}
    for name, f in QUERIES.items():
        seen.setdefault(id(f), name)
    return list(seen.values())


@pytest.mark.parametrize("name", [n for n in distinct() if n in ORACLE_SQL])
def test_equals_oracle(spark, sf_dir, db, name):
    compare(QUERIES[name](spark, sf_dir), db, ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in distinct() if n not in ORACLE_SQL])
def test_runs(spark, sf_dir, name):
    """Those without SQL have tests of their own: test_pages.py, test_sample_trust.py."""
    QUERIES[name](spark, sf_dir).collect()


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
