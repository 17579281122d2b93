import datetime

import pytest

from millrace import Engine
from millrace.sources.keys import join_column

DDL = "CREATE TABLE R (A int, B string, C decimal, D date, PRIMARY KEY (A));"
DAY = datetime.date(1995, 1, 2)


@pytest.fixture
def table(spark, tmp_path):
    def make(text: str, storage: str = "disk") -> Engine:
        (tmp_path / "R.csv").write_text(text)
        engine = Engine(spark, str(tmp_path), storage)
        assert engine.execute(DDL) is None
        return engine

    return make


def rows(engine, sql="SELECT * FROM R ORDER BY A"):
    return [tuple(r) for r in engine.execute(sql).collect()]


@pytest.mark.parametrize(
    ("line", "row"),
    [
        ("1|x|2.5|1995-01-02", (1, "x", 2.5, DAY)),
        ("1|x|2.5|1995-01-02|", (1, "x", 2.5, DAY)),
        ("3|z", (3, "z", None, None)),
        ("2||3.5|1995-01-02", (2, None, 3.5, DAY)),
        ('1|"x y"|2.5|1995-01-02', (1, '"x y"', 2.5, DAY)),
        ('2|"a|3.5|1995-01-02', (2, '"a', 3.5, DAY)),
        ("1| x |2.5|1995-01-02", (1, " x ", 2.5, DAY)),
        ("3000000000|x|2.5|1995-01-02", (3000000000, "x", 2.5, DAY)),
    ],
)
def test_fields(table, line, row):
    assert rows(table(line + "\n")) == [row]


@pytest.mark.parametrize("line", ["1|x|2.5|1995-01-02|more", "1|x|2.5|1995-01-02||more|", "1|x|2.5|1995-01-02|more|"])
@pytest.mark.parametrize("sql", ["SELECT * FROM R", "SELECT A FROM R", "SELECT count(*) FROM R"])
def test_a_value_beyond_the_last_column_fails(table, line, sql):
    with pytest.raises(Exception, match="more than 4 fields"):
        rows(table("2|y|1.0|1995-01-02\n" + line + "\n"), sql)


def test_blank_lines_and_line_ends(table):
    assert [r[0] for r in rows(table("\n1|x|2.5|1995-01-02||\r\n   \n2|y\n\n"))] == [1, 2]


def test_bad_number_fails(table):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        rows(table("2|y|abc|1995-02-03\n"))


def test_repeated_keys_stay(table):
    assert len(rows(table("1|a|1.0|1995-01-02\n1|b|2.0|1995-01-02\n"))) == 2


def test_memory_and_disk_agree(table):
    text = "".join(f"{k}|{'ab'[k % 2]}|{k / 4}|1995-01-0{1 + k % 9}\n" for k in range(50))
    sql = "SELECT B, count(*), sum(C), max(D) FROM R WHERE A > 3 GROUP BY B ORDER BY B"
    memory = table(text, "memory")
    assert memory.catalog.tables["r"].storageLevel.useMemory
    kept = rows(memory, sql)
    memory.catalog.clear()
    disk = table(text)
    assert not disk.catalog.tables["r"].storageLevel.useMemory
    assert rows(disk, sql) == kept


def test_empty_file_and_redefinition(table, tmp_path):
    engine = table("")
    assert rows(engine) == []
    (tmp_path / "R.csv").write_text("1|x|2.5|1995-01-02\n")
    engine.execute(DDL)
    assert len(rows(engine)) == 1


def test_unknown_mode_and_statement(spark):
    with pytest.raises(ValueError, match="storage"):
        Engine(spark, storage="tape")
    with pytest.raises(ValueError, match="supported"):
        Engine(spark).execute("DROP TABLE x")


INDEXED = """CREATE TABLE {name} (ORDERKEY int, CUSTKEY int REFERENCES CUSTOMER(CUSTKEY), NOTE string, PRIMARY KEY (ORDERKEY), INDEX (NOTE, ORDERKEY));"""


def test_indexes_make_sorted_copies_of_disk_tables(spark, tmp_path):
    from millrace.plans.inspect import operators
    from millrace.sources.scratch import workspace

    (tmp_path / "ORDERS.csv").write_text("".join(f"{k}|{k % 7}|n{k % 3}|\n" for k in range(200)))
    (tmp_path / "CUSTOMER.csv").write_text("".join(f"{k}|c{k}|\n" for k in range(7)))
    with workspace():
        engine = Engine(spark, str(tmp_path))
        engine.execute(INDEXED.format(name="ORDERS"))
        engine.execute("CREATE TABLE CUSTOMER (CUSTKEY int, NAME string, INDEX (CUSTKEY))")
        assert set(engine.catalog.copies["orders"]) == {"note", "custkey"}
        assert rows(engine, "SELECT count(*), max(ORDERKEY) FROM ORDERS") == [(200, 199)]
        grouped = engine.execute("SELECT NOTE, count(*) AS n FROM ORDERS GROUP BY NOTE")
        assert "Exchange" not in operators(grouped) and grouped.count() == 3
        joined = engine.catalog.sorted_copy("orders", "custkey").hint("merge").join(engine.catalog.sorted_copy("customer", "custkey"), "CUSTKEY")
        assert "Exchange" not in operators(joined) and joined.count() == 200
        assert engine.catalog.join_keys("orders", "customer") == [("CUSTKEY", "CUSTKEY")]
        copies = list(engine.catalog.copies["orders"].values())
        engine.execute(INDEXED.format(name="ORDERS"))
        assert not any(spark.catalog.tableExists(c) for c in copies)
        copies = list(engine.catalog.copies["orders"].values())
    assert not any(spark.catalog.tableExists(c) for c in copies) and not engine.catalog.tables


def test_memory_tables_have_no_copies(spark, tmp_path):
    (tmp_path / "ORDERS.csv").write_text("1|2|x|\n")
    engine = Engine(spark, str(tmp_path), "memory")
    engine.execute(INDEXED.format(name="ORDERS"))
    assert not engine.catalog.copies and rows(engine, "SELECT * FROM ORDERS") == [(1, 2, "x")]
    engine.catalog.clear()


def test_join_keys_of_definitions(spark, tmp_path):
    for name in ("LINEITEM", "PART", "OTHER"):
        (tmp_path / f"{name}.csv").write_text("1|2|\n")
    engine = Engine(spark, str(tmp_path))
    engine.run("CREATE TABLE LINEITEM (ORDERKEY int, PARTKEY int); CREATE TABLE PART (PARTKEY int, NAME string, PRIMARY KEY (PARTKEY)); CREATE TABLE OTHER (A int, B int)")
    assert engine.catalog.join_keys("lineitem", "part") == [("PARTKEY", "PARTKEY")]
    with pytest.raises(ValueError, match="refer"):
        engine.catalog.join_keys("lineitem", "other")
    engine.catalog.clear()


def test_foreign_keys():
    assert join_column("lineitem", "orders") == "ORDERKEY"
    assert join_column("region", "nation") is None
