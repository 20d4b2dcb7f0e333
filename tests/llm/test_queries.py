import pytest

from ledgerlight.llm import queries

COLUMNS = {"p1_found": {"src", "row_id", "pos"}, "p2_found": {"src", "row_id"}, "p5_found": {"column_name", "item_value"}, "p6_ids": {"doc_id", "ids"}, "p7_found": {"doc_id", "item_id"}, "p8_found": {"doc_id", "category"}}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(name, spark, data):
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert set(df.columns) == COLUMNS.get(name, set(df.columns))
    if name.endswith("_found"):
        assert len(set(map(str, rows))) == len(rows)
