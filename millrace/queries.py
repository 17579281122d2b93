"""Registered queries with their SQL twins: one or more for each relational operator.

Row-level doubles are given raw.  Sums are rounded at the scale of their exact value, or made over
decimals, so that no result depends on the order of addition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import aggregates as agg
from millrace.operators.joins import chain_join, hash_join, merge_join
from millrace.operators.layout import buckets_for, drop_stored, store_sorted, stored
from millrace.operators.ordering import limited, ordered, top
from millrace.plans.engine import Engine
from millrace.sources.pipe import pipe_lines, write_pipe
from millrace.sources.scratch import hold, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder, read when first named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._read = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]


def query(oracle: str | None):
    """Register a function of ``Tables`` under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def statement(name: str, tables: str, sql: str, oracle: str | None = None) -> None:
    """Register one SQL text that the engine and the oracle both run."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with own_views(spark, tables.split()):
            engine = Engine(spark, sf_dir)
            for t in tables.split():
                engine.parquet(t)
            result = engine.execute(sql)  # names are resolved here, so the views may go
            engine.catalog.clear()
        return result

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or sql


@contextmanager
def own_views(spark: SparkSession, names: list[str]):
    """Names for views of ours; views that the caller has under them come back."""
    catalog = spark._jsparkSession.sessionState().catalog()
    before = {n: spark.table(n) for n in names if catalog.getTempView(n).isDefined()}
    try:
        yield
    finally:
        for name, view in before.items():
            view.createOrReplaceTempView(name)


def net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def revenue() -> Column:
    return F.round(F.sum(net()), 4)


# Projections and filters


@query("SELECT * FROM nation")
def scan_star(t):
    return t.nation.select("*")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice AS price FROM orders")
def project_columns(t):
    return t.orders.select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + l_tax AS sum2, l_linenumber - 10 AS less FROM lineitem")
def project_arithmetic(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", net().alias("net"), (F.col("l_quantity") + F.col("l_tax")).alias("sum2"), (F.col("l_linenumber") - 10).alias("less")
    )


@query("SELECT l_orderkey, l_partkey, l_extendedprice / l_quantity AS unit FROM lineitem")
def project_division(t):
    return t.lineitem.select("l_orderkey", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 'high' ELSE 'low' END AS urgency FROM orders")
def project_case(t):
    priority = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", F.when((priority == "1-URGENT") | (priority == "2-HIGH"), "high").otherwise("low").alias("urgency"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_equal(t):
    return t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name", "c_acctbal")


@query("""SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem
    WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24""")
def filter_range(t):
    ship, discount = F.col("l_shipdate"), F.col("l_discount")
    kept = t.lineitem.where((ship >= F.lit("1996-01-01").cast("timestamp_ntz")) & (ship < F.lit("1997-01-01").cast("timestamp_ntz")))
    return kept.where((discount >= 0.05) & (discount <= 0.07) & (F.col("l_quantity") < 24)).select("l_orderkey", "l_quantity", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R' OR l_returnflag = 'A'")
def filter_or(t):
    flag = F.col("l_returnflag")
    return t.lineitem.where((flag == "R") | (flag == "A")).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_discount < l_tax")
def filter_two_columns(t):
    return t.lineitem.where(F.col("l_discount") < F.col("l_tax")).select("l_orderkey", "l_linenumber", "l_tax")


@query("SELECT p_partkey, p_size FROM part WHERE 40 < p_size AND 1000 >= p_retailprice")
def filter_literal_first(t):
    return t.part.where((F.lit(40) < F.col("p_size")) & (F.lit(1000) >= F.col("p_retailprice"))).select("p_partkey", "p_size")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def point_lookup(t):
    return t.orders.where(F.col("o_orderkey") == 42).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey FROM lineitem WHERE l_quantity > 10 AND l_quantity < 5")
def filter_contradiction(t):
    return t.lineitem.where((F.col("l_quantity") > 10) & (F.col("l_quantity") < 5)).select("l_orderkey")


statement("filter_date_function", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < date('1997-01-01') AND o_orderstatus = 'F'",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < CAST('1997-01-01' AS DATE) AND o_orderstatus = 'F'")
statement("filter_more_predicates", "part", """SELECT p_partkey, p_type FROM part
    WHERE p_size BETWEEN 5 AND 20 AND p_type IN ('PROMO', 'SMALL', 'ECONOMY') AND p_brand LIKE 'Brand#1%' AND p_brand <> 'Brand#11' AND NOT p_size = 7""")
statement("nested_filter", "lineitem", "SELECT l_orderkey, l_quantity FROM (SELECT * FROM lineitem WHERE l_quantity > 30) a WHERE l_discount >= 0.05")
statement("nested_two_levels", "lineitem", """SELECT l_orderkey, net FROM (
    SELECT l_orderkey, l_tax, l_extendedprice * (1 - l_discount) AS net FROM (SELECT * FROM lineitem WHERE l_returnflag = 'N') a WHERE l_quantity < 20
) b WHERE l_tax > 0.03""")
statement("nested_limit", "orders", "SELECT count(*) AS n, sum(o_orderkey) AS keys FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10) a",
    "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10) a")

# Aggregates


@query("""SELECT round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_extendedprice) AS least, max(l_extendedprice) AS most,
    count(*) AS n FROM lineitem""")
def global_aggregates(t):
    price = F.col("l_extendedprice")
    return agg.grouped(
        t.lineitem, [], total=F.round(agg.total(price), 2), mean=F.round(agg.mean(F.col("l_quantity")), 6), least=F.min(price), most=F.max(price), n=agg.counted()
    )


@query("SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(sum(l_quantity + l_linenumber), 2) AS added FROM lineitem")
def sum_arithmetic(t):
    return agg.grouped(t.lineitem, [], revenue=revenue(), added=F.round(agg.total(F.col("l_quantity"), F.col("l_linenumber")), 2))


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def count_rows(t):
    return agg.grouped(t.lineitem.where(F.col("l_returnflag") == "R"), [], n=agg.counted())


@query("SELECT count(nullif(o_orderstatus, 'F')) AS n, count(DISTINCT o_orderstatus) AS kinds FROM orders")
def count_column(t):
    status = F.col("o_orderstatus")
    return agg.grouped(t.orders, [], n=agg.counted(F.nullif(status, F.lit("F"))), kinds=F.count_distinct(status))


@query("SELECT sum(l_quantity) AS total, avg(l_quantity) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n FROM lineitem WHERE l_quantity < 0")
def empty_aggregates(t):
    q = F.col("l_quantity")
    return agg.grouped(t.lineitem.where(q < 0), [], total=agg.total(q), mean=agg.mean(q), least=F.min(q), most=F.max(q), n=agg.counted())


@query("""SELECT min(o_orderpriority) AS first_priority, max(o_orderpriority) AS last_priority, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS first_day,
    CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_day FROM orders""")
def minmax_typed(t):
    day = F.col("o_orderdate").cast("date")
    priority = F.col("o_orderpriority")
    return agg.grouped(t.orders, [], first_priority=F.min(priority), last_priority=F.max(priority), first_day=F.min(day).cast("string"), last_day=F.max(day).cast("string"))


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_discount > 0.02 GROUP BY l_returnflag")
def group_one(t):
    return agg.grouped(t.lineitem.where(F.col("l_discount") > 0.02), ["l_returnflag"], n=agg.counted(), quantity=agg.total(F.col("l_quantity")))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_two(t):
    return agg.grouped(t.lineitem, ["l_returnflag", "l_linestatus"], revenue=revenue())


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, max(l_tax) AS tax FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
def group_three(t):
    return agg.grouped(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"], n=agg.counted(), tax=F.max("l_tax"))


@query("SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY o_custkey")
def group_no_where(t):
    return agg.grouped(t.orders, ["o_custkey"], n=agg.counted(), mean=F.round(agg.mean(F.col("o_totalprice")), 6))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority DESC")
def group_order_desc(t):
    return ordered(agg.grouped(t.orders, ["o_orderpriority"], n=agg.counted()), ("o_orderpriority", False))


@query("""SELECT l_partkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem
    GROUP BY l_partkey ORDER BY revenue DESC, l_partkey LIMIT 15""")
def group_order_alias(t):
    return top(agg.grouped(t.lineitem, ["l_partkey"], revenue=revenue()), 15, ("revenue", False), "l_partkey")


@query("""SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high,
    CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low
    FROM orders, lineitem WHERE o_orderkey = l_orderkey GROUP BY l_returnflag""")
def case_aggregate(t):
    joined = chain_join(t.lineitem, (t.orders, [("l_orderkey", "o_orderkey")]))
    high = (F.col("o_orderpriority") == "1-URGENT") | (F.col("o_orderpriority") == "2-HIGH")
    return agg.grouped(joined, ["l_returnflag"], high=agg.counted_where(high), low=agg.counted_where(~high))


statement("group_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
statement("aggregate_arithmetic", "lineitem", """SELECT l_linestatus, round(100 * sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS share
    FROM lineitem GROUP BY l_linestatus""")

# Sorts and limits


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderkey")
def order_one(t):
    return ordered(t.orders.where(F.col("o_totalprice") > 300000).select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey")
def order_two_mixed(t):
    return ordered(t.customer.select("c_mktsegment", "c_custkey"), ("c_mktsegment", False), "c_custkey")


@query("SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_brand, p_size DESC, p_partkey")
def order_three(t):
    return ordered(t.part.select("p_brand", "p_size", "p_partkey"), "p_brand", ("p_size", False), "p_partkey")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 7")
def limit_rows(t):
    return limited(ordered(t.nation.select("n_nationkey", "n_name"), "n_nationkey"), 7)


@query("SELECT n_nationkey FROM nation LIMIT 0")
def limit_zero(t):
    return limited(t.nation.select("n_nationkey"), 0)


@query("""SELECT l_extendedprice, l_orderkey, l_linenumber, l_partkey FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25""")
def top_k(t):
    rows = t.lineitem.select("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    return top(rows, 25, ("l_extendedprice", False), "l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT l_shipdate_day, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate_day FROM lineitem) a
    ORDER BY l_shipdate_day, l_orderkey, l_linenumber, l_partkey, l_suppkey""")
def sort_large(t):
    rows = t.lineitem.select(F.col("l_shipdate").cast("date").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    by_day = ordered(rows, "day", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return by_day.select(F.col("day").cast("string").alias("l_shipdate_day"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# Joins


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders, customer WHERE o_custkey = c_custkey AND o_orderstatus = 'O'")
def join_hash(t):
    orders = t.orders.where(F.col("o_orderstatus") == "O")
    return hash_join(orders, t.customer, [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_totalprice FROM lineitem, orders WHERE l_orderkey = o_orderkey")
def join_merge(t):
    return merge_join(t.lineitem, t.orders, [("l_orderkey", "o_orderkey")]).select("l_orderkey", "l_linenumber", "l_partkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, p_name, p_size FROM lineitem, part WHERE l_partkey = p_partkey AND p_size > 25")
def join_pk_side(t):
    return hash_join(t.lineitem, t.part.where(F.col("p_size") > 25), [("l_partkey", "p_partkey")]).select("l_orderkey", "l_linenumber", "p_name", "p_size")


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def join_small(t):
    return chain_join(t.nation, (t.region, [("n_regionkey", "r_regionkey")])).select("n_name", "r_name")


@query("""SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, lines, l_quantity FROM lineitem,
    (SELECT l_orderkey AS k1, l_suppkey AS k2, count(*) AS lines FROM lineitem GROUP BY l_orderkey, l_suppkey) g WHERE l_orderkey = k1 AND l_suppkey = k2""")
def join_two_keys(t):
    groups = agg.grouped(t.lineitem, [F.col("l_orderkey").alias("k1"), F.col("l_suppkey").alias("k2")], lines=agg.counted())
    joined = merge_join(t.lineitem, groups, [("l_orderkey", "k1"), ("l_suppkey", "k2")])
    return joined.select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "lines", "l_quantity")


@query("SELECT s_suppkey, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer, supplier WHERE c_nationkey = s_nationkey GROUP BY s_suppkey")
def join_many_to_many(t):
    """Customers are combined by nation before they meet suppliers, so no pair of the two is ever made."""
    nations = agg.grouped(t.customer, [F.col("c_nationkey").alias("nation")], n=agg.counted(), sum=agg.total(F.col("c_acctbal")))
    joined = hash_join(t.supplier, nations, [("s_nationkey", "nation")])
    return agg.grouped(joined, ["s_suppkey"], customers=F.sum("n"), balance=F.round(F.sum("sum"), 2))


@query("""SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey
    AND c_mktsegment = 'BUILDING' AND c_acctbal > 9000 AND s_acctbal > 5000""")
def join_many_pairs(t):
    """Every pair of equal keys, many on both sides."""
    customers = t.customer.where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000))
    return merge_join(customers, t.supplier.where(F.col("s_acctbal") > 5000), [("c_nationkey", "s_nationkey")]).select("c_custkey", "s_suppkey")


@query("""SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, nation
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_nationkey = n_nationkey GROUP BY n_name""")
def join_four_chain(t):
    steps = (t.orders, [("l_orderkey", "o_orderkey")]), (t.customer, [("o_custkey", "c_custkey")]), (t.nation, [("c_nationkey", "n_nationkey")])
    return agg.grouped(chain_join(t.lineitem, *steps), ["n_name"], n=agg.counted(), revenue=revenue())


# the tables stand from small to large, so that what region and supplier leave out never meets orders
SMALL_FIRST = "FROM region, nation, supplier, lineitem, orders, customer"
AS_ASKED = "FROM customer, orders, lineitem, supplier, nation, region"
SIX_CYCLIC = """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM customer, orders, lineitem, supplier, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name"""
statement("join_six_cyclic", "customer orders lineitem supplier nation region", SIX_CYCLIC.replace(AS_ASKED, SMALL_FIRST), SIX_CYCLIC)
statement("join_explicit_on", "orders customer nation", """SELECT o.o_orderkey, c.c_name, n.n_name
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 250000""")
statement("join_self", "nation", "SELECT a.n_name AS first_name, b.n_name AS second_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
statement("join_filter_pushdown", "orders customer lineitem", """SELECT c_custkey, o_orderkey, l_linenumber, l_partkey FROM customer, orders, lineitem
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_quantity > 45 AND o_orderpriority <> '5-LOW' AND c_mktsegment IN ('BUILDING', 'MACHINERY')
        AND o_totalprice BETWEEN 1000 AND 300000 AND c_name LIKE '%1%' AND (l_returnflag = 'R' OR l_tax < 0.02)""")
statement("join_group", "orders customer", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer, orders WHERE c_custkey = o_custkey GROUP BY c_mktsegment")
statement("join_group_order_limit", "customer orders lineitem", """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
statement("join_star_columns", "nation region", "SELECT * FROM nation, region WHERE n_regionkey = r_regionkey")
statement("join_several_predicates", "lineitem orders", """SELECT l_orderkey, l_linenumber, l_partkey, o_orderkey FROM lineitem, orders
    WHERE l_orderkey = o_orderkey AND l_extendedprice < o_totalprice AND l_shipdate > o_orderdate""")
statement("union_rows", "customer supplier", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey AS nation FROM supplier")

# The TPC-H shapes that the tables allow

statement("q1", "lineitem", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
        round(sum(l_extendedprice * (1 - l_discount)), 3) AS sum_disc_price,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2)))) AS DOUBLE) AS sum_charge,
        round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= CAST('1998-09-02' AS DATE) GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
statement("q3", "customer orders lineitem", """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, o_orderpriority
    FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
        AND o_orderdate < CAST('1997-03-15' AS DATE) AND l_shipdate > CAST('1997-03-15' AS DATE)
    GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, day, l_orderkey LIMIT 10""")
Q5 = """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM customer, orders, lineitem, supplier, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
        AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= CAST('1996-01-01' AS DATE) AND o_orderdate < CAST('1998-01-01' AS DATE)
    GROUP BY n_name ORDER BY revenue DESC, n_name"""
statement("q5", "customer orders lineitem supplier nation region", Q5.replace(AS_ASKED, SMALL_FIRST), Q5)
statement("q6", "lineitem", """SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
    WHERE l_shipdate >= CAST('1996-01-01' AS DATE) AND l_shipdate < CAST('1997-01-01' AS DATE) AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
statement("q10", "customer orders lineitem nation", """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, c_acctbal, n_name
    FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        AND o_orderdate >= CAST('1996-10-01' AS DATE) AND o_orderdate < CAST('1997-01-01' AS DATE)
    GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
statement("q12", "orders lineitem", """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
        CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
    FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= CAST('1997-01-01' AS DATE) AND l_shipdate < CAST('1998-01-01' AS DATE)
    GROUP BY l_linestatus ORDER BY l_linestatus""")
statement("events_batch", "events", "SELECT event_type, count(*) AS n, round(max(value), 6) AS most FROM events GROUP BY event_type")

# Text tables: write bars, define the table by DDL, read it back


def _as_text(spark: SparkSession, name: str, df: DataFrame, ddl: str, sql: str, storage: str) -> DataFrame:
    folder = scratch(spark, "pipe")
    write_pipe(df, f"{folder}/{name}.csv")
    engine = Engine(spark, folder, storage)
    engine.execute(ddl)
    return engine.execute(sql)


ORDERS_DDL = """CREATE TABLE TEXT_ORDERS (ORDERKEY int, CUSTKEY int REFERENCES CUSTOMER(CUSTKEY), ORDERSTATUS char(1), TOTALPRICE decimal(12,2),
    ORDERDATE date, ORDERPRIORITY varchar(15), PRIMARY KEY (ORDERKEY), INDEX (CUSTKEY));"""
ORDERS_SQL = "SELECT orderstatus, count(*) AS n, round(sum(totalprice), 2) AS total, max(orderkey) AS last_key FROM text_orders WHERE orderdate >= date('1996-06-01') GROUP BY orderstatus"
ORDERS_ORACLE = """SELECT o_orderstatus AS orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last_key
    FROM orders WHERE o_orderdate >= DATE '1996-06-01' GROUP BY o_orderstatus"""


def _text_orders(t, storage: str) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date"), "o_orderpriority")
    return _as_text(t.spark, "TEXT_ORDERS", rows, ORDERS_DDL, ORDERS_SQL, storage)


@query(ORDERS_ORACLE)
def text_table_disk(t):
    return _text_orders(t, "disk")


@query(ORDERS_ORACLE)
def text_table_memory(t):
    return _text_orders(t, "memory")


@query("SELECT n_nationkey || '|' || n_name || '|' || n_regionkey || '|' AS line FROM nation")
def bar_lines(t):
    return pipe_lines(t.nation.select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT l_orderkey, count(*) AS n, max(o_totalprice) AS price FROM lineitem, orders WHERE l_orderkey = o_orderkey GROUP BY l_orderkey")
def join_stored_sorted(t):
    """Both tables are stored in buckets by their key, once for a session; the join and the grouping move no row."""
    lines, orders = t.lineitem.select("l_orderkey"), t.orders.select("o_orderkey", "o_totalprice")
    tag, buckets = hashlib.md5(f"{t.sf_dir} {t.spark.sparkContext.applicationId}".encode()).hexdigest()[:12], buckets_for(lines, orders)
    names = [f"millrace_sorted_{kind}_{tag}" for kind in ("lineitem", "orders")]
    for name, df, key in zip(names, (lines, orders), ("l_orderkey", "o_orderkey"), strict=True):
        if not t.spark.catalog.tableExists(name):
            store_sorted(df, name, key, buckets, scratch(t.spark, "sorted"))
            hold(name, lambda name=name: drop_stored(t.spark, name))
    joined = merge_join(*(stored(t.spark, name) for name in names), [("l_orderkey", "o_orderkey")])
    return agg.grouped(joined, ["l_orderkey"], n=agg.counted(), price=F.max("o_totalprice"))


@query("""SELECT c_mktsegment AS mktsegment, count(*) AS n, max(o_totalprice) AS most FROM customer, orders WHERE c_custkey = o_custkey GROUP BY c_mktsegment""")
def join_by_reference(t):
    """Two text tables joined by the key that their definitions name; orders are stored in its order."""
    folder = scratch(t.spark, "pipe")
    write_pipe(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), f"{folder}/REF_ORDERS.csv")
    write_pipe(t.customer.select("c_custkey", "c_mktsegment"), f"{folder}/REF_CUSTOMER.csv")
    engine = Engine(t.spark, folder)
    engine.run("""CREATE TABLE REF_CUSTOMER (CUSTKEY int, MKTSEGMENT char(10), PRIMARY KEY (CUSTKEY));
        CREATE TABLE REF_ORDERS (ORDERKEY int, CUSTKEY int, TOTALPRICE decimal, PRIMARY KEY (ORDERKEY), FOREIGN KEY (CUSTKEY) REFERENCES REF_CUSTOMER);""")
    orders, customers = (engine.catalog.tables[name] for name in ("ref_orders", "ref_customer"))
    joined = hash_join(orders, customers, engine.catalog.join_keys("REF_ORDERS", "REF_CUSTOMER"))
    return agg.grouped(joined, ["mktsegment"], n=agg.counted(), most=F.max("totalprice"))


@query("""SELECT CAST(n_regionkey AS BIGINT) AS a, count(*) AS n, min(n_name) AS first_name, max(n_name) AS last_name FROM nation GROUP BY n_regionkey""")
def text_repeated_keys(t):
    """Rows that share a primary key all stay."""
    rows = t.nation.select("n_regionkey", "n_name")
    ddl = "CREATE TABLE TEXT_KEYS (A int, B varchar(25), PRIMARY KEY (A));"
    return _as_text(t.spark, "TEXT_KEYS", rows, ddl, "SELECT a, count(*) AS n, min(b) AS first_name, max(b) AS last_name FROM text_keys GROUP BY a", "disk")


SESSION = """CREATE TABLE TALK (A int,
    B varchar(25), -- a semicolon ; in a comment
    PRIMARY KEY (A));
SELECT count(*) FROM TALK; SELECT min(A) AS least -- , nothing
    , max(A) AS most /* two ; columns */ FROM TALK;
SELECT ';' AS mark, B FROM TALK WHERE A = 3;
SELECT A, B FROM TALK WHERE B LIKE '%2'
ORDER BY A DESC;
SELECT B FROM TALK WHERE A < 0;
exit;
SELECT 1;
"""


@query("""WITH said(nth, line) AS (
        SELECT 0, count(*) || '|' FROM nation
        UNION ALL SELECT 1, min(n_nationkey) || '|' || max(n_nationkey) || '|' FROM nation
        UNION ALL SELECT 2, ';|' || n_name || '|' FROM nation WHERE n_nationkey = 3
        UNION ALL SELECT CAST(2 + row_number() OVER (ORDER BY n_nationkey DESC) AS INTEGER), n_nationkey || '|' || n_name || '|' FROM nation WHERE n_name LIKE '%2'
        UNION ALL SELECT CAST(3 + count(*) AS INTEGER), '' FROM nation WHERE n_name LIKE '%2'
    ) SELECT CAST(nth AS BIGINT) AS nth, line FROM said""")
def prompt_session(t):
    """What the prompt prints for a script of several statements, a line a row, without the prompts."""
    import io

    from millrace.repl import PROMPT, repl

    folder, out = scratch(t.spark, "pipe"), io.StringIO()
    write_pipe(t.nation.select("n_nationkey", "n_name"), f"{folder}/TALK.csv")
    engine = Engine(t.spark, folder)
    repl(engine, io.StringIO(SESSION), out)
    engine.catalog.clear()
    said = out.getvalue().replace(PROMPT, "").split("\n")[:-1]
    return t.spark.createDataFrame(list(enumerate(said)), "nth long, line string")
