import pytest

from quarrylens.plans.queries import ORACLE_SQL, QUERIES

from .oracle import same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, small, name):
    same(QUERIES[name](spark, small), small, ORACLE_SQL[name])


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "title", "original_uri", "content_hash", "source_name", "source_type", "source_priority"]
    assert df.count() == 100
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
