"""Every registered query of the reference's operators beside its SQL."""

import pytest
from compare import assert_same, views

from foliant.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return views(SF)


#: Queries that are cheap enough for larger tables too, where more of a rule's cases occur.
LARGER = [x for x in SQL if x[:3] in ("c01", "c02", "c13", "c14", "c15", "c18", "e05", "e09", "f01", "g09", "h08", "h14", "h18", "h25", "a03", "a05", "a07")]


@pytest.mark.parametrize("name", sorted(LARGER))
def test_query_on_larger_tables(spark, name):
    path = "/root/testdata/sf0.01"
    assert_same(registry.queries()[name](spark, path), views(path), SQL[name])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    if name in SQL:
        assert_same(df, con, SQL[name])
    else:
        assert df.count() > 0
