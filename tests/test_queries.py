import pytest

from millrace.queries import ORACLE_SQL, QUERIES

EMPTY = {"filter_contradiction", "limit_zero"}


@pytest.mark.parametrize("name", QUERIES)
def test_against_sql(name, spark, sf_dir, duck, same_rows):
    same_rows(QUERIES[name](spark, sf_dir), duck.sql(ORACLE_SQL[name]), may_be_empty=True)


@pytest.mark.parametrize("name", ["order_one", "order_two_mixed", "order_three", "group_order_desc", "group_order_alias", "top_k", "sort_large"])
def test_order(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    assert [tuple(r) for r in df.collect()] == duck.sql(ORACLE_SQL[name]).fetchall()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
