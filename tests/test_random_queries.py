from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace import Engine

COLUMNS = {"l_quantity": (0, 60), "l_linenumber": (0, 9), "l_discount": (0, 0.12), "l_tax": (0, 0.1)}
predicate = st.sampled_from(sorted(COLUMNS)).flatmap(
    lambda c: st.tuples(st.just(c), st.sampled_from(["=", "<", "<=", ">", ">=", "<>"]), st.integers(0, 20).map(lambda k: COLUMNS[c][0] + k / 20 * (COLUMNS[c][1] - COLUMNS[c][0])))
)
where = st.lists(predicate, min_size=1, max_size=3).flatmap(
    lambda ps: st.sampled_from([" AND ", " OR "]).map(lambda glue: glue.join(f"{c} {op} {x:.3f}" for c, op, x in ps))
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(where=where, keys=st.lists(st.sampled_from(["l_returnflag", "l_linestatus", "l_linenumber"]), unique=True, max_size=3), n=st.integers(1, 20))
def test_group_order_limit(spark, sf_dir, duck, where, keys, n):
    engine = Engine(spark, sf_dir)
    engine.parquet("lineitem")
    columns = ", ".join([*keys, "count(*) AS n", "round(sum(l_quantity), 2) AS q", "max(l_tax) AS t"])
    sql = f"SELECT {columns} FROM lineitem WHERE {where}"
    if keys:
        sql += f" GROUP BY {', '.join(keys)} ORDER BY {', '.join(keys)} LIMIT {n}"
    assert [tuple(r) for r in engine.execute(sql).collect()] == duck.sql(sql).fetchall()
