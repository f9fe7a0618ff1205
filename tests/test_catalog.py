import pytest

from corvane.plans import catalog

from .oracle import frame, rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(frame(catalog.ORACLES[name], sf))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qid", "rank", "doc_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
