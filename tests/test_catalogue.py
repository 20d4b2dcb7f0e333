import pytest

from ledgerlight import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(name, same, spark, data):
    if name in catalogue.SQL:
        same(catalogue.QUERIES[name], catalogue.SQL[name])
    else:
        assert catalogue.QUERIES[name](spark, data).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
