"""The queries that SQL can express, against DuckDB."""

import pytest
from harness import compare, connect

from marketgrain.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_equals_oracle(spark, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])
