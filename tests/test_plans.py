import pytest
from pyspark.sql import functions as F

from millrace import Engine
from millrace.operators.joins import chain_join, hash_join, merge_join
from millrace.operators.layout import buckets_for, skewed, store_sorted, stored
from millrace.operators.ordering import limited, top
from millrace.plans.inspect import estimated_bytes, operators, plan_text, pushed_filters, read_columns
from millrace.queries import QUERIES, Tables


@pytest.fixture
def t(spark, sf_dir):
    return Tables(spark, sf_dir)


def test_hash_join_broadcasts_only_a_small_side(t):
    keys = [("o_custkey", "c_custkey")]
    assert "BroadcastHashJoin" in operators(hash_join(t.orders, t.customer, keys))
    t.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in operators(hash_join(t.orders, t.customer, keys, limit=10))
    finally:
        t.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merge_join(t):
    assert "SortMergeJoin" in operators(merge_join(t.lineitem, t.orders, [("l_orderkey", "o_orderkey")]))


def test_join_needs_keys(t):
    with pytest.raises(ValueError, match="pair"):
        chain_join(t.orders, (t.customer, []))


def test_filters_and_columns_reach_the_scan(t):
    df = t.lineitem.where(F.col("l_quantity") > 45).select("l_orderkey")
    assert "GreaterThan(l_quantity,45.0)" in pushed_filters(df)
    assert read_columns(df) == ["struct<l_orderkey:bigint,l_quantity:double>"]


def test_filters_pass_below_joins(t, spark, sf_dir):
    engine = Engine(spark, sf_dir)
    for name in ("orders", "customer"):
        engine.parquet(name)
    df = engine.execute("SELECT c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING' AND o_totalprice > 1000")
    pushed = pushed_filters(df)
    assert "EqualTo(c_mktsegment,BUILDING)" in pushed and "GreaterThan(o_totalprice,1000.0)" in pushed
    assert "Join" in engine.explain("SELECT c_name FROM orders, customer WHERE o_custkey = c_custkey")


def test_nested_selects_become_one_filter(t, spark, sf_dir):
    engine = Engine(spark, sf_dir)
    engine.parquet("lineitem")
    df = engine.execute("SELECT l_orderkey FROM (SELECT * FROM (SELECT * FROM lineitem WHERE l_tax > 0) a WHERE l_quantity > 3) b WHERE l_discount > 0")
    assert operators(df).count("Filter") == 1


def test_top_k_needs_no_full_sort(t):
    assert "TakeOrderedAndProject" in operators(top(t.orders, 5, ("o_totalprice", False), "o_orderkey"))
    with pytest.raises(ValueError, match="negative"):
        limited(t.orders, -1)


def test_aggregates_combine_before_the_shuffle(t):
    text = plan_text(t.lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity")), "simple")
    assert "partial_sum" in text and "hashpartitioning(l_returnflag" in text


def test_stored_order_saves_the_shuffle(t, tmp_path):
    store_sorted(t.lineitem.select("l_orderkey"), "stored_l", "l_orderkey", 4, str(tmp_path / "l"))
    store_sorted(t.orders.select("o_orderkey"), "stored_o", "o_orderkey", 4, str(tmp_path / "o"))
    joined = merge_join(stored(t.spark, "stored_l"), stored(t.spark, "stored_o"), [("l_orderkey", "o_orderkey")])
    assert "Exchange" not in operators(joined)
    assert joined.count() == t.lineitem.count()


def test_frequent_keys_are_stored_in_ranges(spark, tmp_path):
    rows = spark.range(8000, numPartitions=16)
    other = rows.selectExpr("id as j")
    assert not skewed(rows, "id", 8) and not skewed(rows.limit(0), "id", 8)
    often, null = (rows.selectExpr(f"if(id < 7000, {hot}, id) as k", "id as v") for hot in ("7", "null"))
    for name, df in (("stored_hot", often), ("stored_null", null)):
        assert skewed(df, "k", 8)
        store_sorted(df, name, "k", 8, str(tmp_path / name))
        copy = stored(spark, name)
        assert sorted(copy.collect(), key=str) == sorted(df.collect(), key=str)
        joined = merge_join(copy, other, [("k", "j")])
        assert "Exchange" in operators(joined) and joined.count() == df.where("k is not null").count()
        # no file holds more than a small part of the rows, and each is in order
        sizes = copy.groupBy("_metadata.file_path").count().collect()
        assert len(sizes) == 8 and max(r["count"] for r in sizes) < df.count() / 3
        for r in sizes:
            held = [x["k"] for x in spark.read.parquet(r["file_path"]).collect()]
            assert held == sorted(held, key=lambda k: (k is not None, k))
        spark.sql(f"DROP TABLE {name}")


def test_estimate_grows_with_the_table(t):
    assert estimated_bytes(t.region) < estimated_bytes(t.lineitem)


def test_buckets_grow_with_the_table(t):
    assert buckets_for(t.region) == 1 and buckets_for(t.region, t.lineitem) == buckets_for(t.lineitem)
    from millrace.operators import layout

    size = estimated_bytes(t.lineitem)
    for n, want in ((1, 1), (2, 2), (3, 4), (100, 128)):
        assert _with(layout, "BUCKET_BYTES", -(-size // n), lambda: buckets_for(t.lineitem)) == want


def _with(module, name, value, call):
    before = getattr(module, name)
    setattr(module, name, value)
    try:
        return call()
    finally:
        setattr(module, name, before)


def test_many_to_many_aggregates_before_the_join(spark, sf_dir):
    text = plan_text(QUERIES["join_many_to_many"](spark, sf_dir), "simple")
    join = next(line for line in text.splitlines() if "Join" in line)
    below = text[text.index(join) :]
    assert "c_nationkey" in below and below.count("HashAggregate(keys=[c_nationkey") >= 2


@pytest.mark.parametrize("name", ["q5", "join_six_cyclic"])
def test_small_tables_join_first(spark, sf_dir, name):
    """Line items meet suppliers of the region before they meet orders."""
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    order = [text.index(c) for c in ("r_regionkey", "s_suppkey")]
    joins = [line for line in text.splitlines() if "Join Inner" in line]
    assert len(joins) == 5 and order
    inner = joins[-1]
    assert "n_regionkey" in inner and "r_regionkey" in inner
    depth = lambda c: next(len(line) - len(line.lstrip(" :+-")) for line in joins if c in line)
    assert depth("l_suppkey") > depth("o_orderkey")


def test_stored_tables_are_made_once(spark, sf_dir):
    from millrace.sources.scratch import workspace

    with workspace():
        first = QUERIES["join_stored_sorted"](spark, sf_dir)
        tables = {x.name for x in spark.catalog.listTables()}
        second = QUERIES["join_stored_sorted"](spark, sf_dir)
        assert {x.name for x in spark.catalog.listTables()} == tables
        assert "Exchange" not in operators(second) and first.count() == second.count()


def test_sorts_by_dates_not_by_their_text(spark, sf_dir):
    text = plan_text(QUERIES["sort_large"](spark, sf_dir), "simple")
    assert "Sort [day#" in text


@pytest.mark.parametrize("name", QUERIES)
def test_nothing_is_left_behind(spark, sf_dir, name):
    """Catalogue, settings and scratch folder are as before when a query's result has been used."""
    import os

    from millrace.sources.scratch import workspace

    mark = spark.createDataFrame([(7,)], "mine int")
    mark.createOrReplaceTempView("lineitem")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    state = lambda: (sorted((t.name, t.isTemporary) for t in spark.catalog.listTables()), sorted(spark.conf.getAll.items()), sorted(os.listdir(folder)) if os.path.isdir(folder) else [])
    before = state()
    with workspace():
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    after = state()
    assert spark.table("lineitem").collect()[0]["mine"] == 7
    spark.catalog.dropTempView("lineitem")
    assert after == before
