import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from oracle import rows, run_sql  # noqa: E402

from corpusmill.plans.catalog import QUERIES, SQL, flagship  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got), "nothing found"
    if name in SQL:
        want = run_sql(SQL[name], SF)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_flagship(spark):
    assert flagship(spark, "/root/testdata/sf0.01").count() > 0


def test_most_queries_have_sql():
    assert len(SQL) > 0.9 * len(QUERIES)
