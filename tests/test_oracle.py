"""Every registered query with SQL gives the rows that the SQL gives, in any order of its input."""

import pytest

from millrace.plans import registry
from oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    assert difference(spark, SF, registry.QUERIES[name], registry.ORACLES[name]) == ""


#: Queries that SQL can't express; tests of their own hold them against a library.
WITHOUT_SQL = {"q_exact_tokens"}


def test_all_have_sql():
    assert set(registry.QUERIES) - WITHOUT_SQL == set(registry.ORACLES) and registry.FLAGSHIP in registry.QUERIES


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(registry.QUERIES) <= set(e.queries())
