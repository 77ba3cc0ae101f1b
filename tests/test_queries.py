import pytest

from corpusloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, agrees):
    agrees(registry.QUERIES[name], registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "doc_id", "chunk_no", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
