import os

import pytest

from flowlark.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import same

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_oracle(spark, name):
    assert same(spark, name, QUERIES[name], ORACLE_SQL[name], FOLDER)[0] > 0
