import pytest
from pyspark.sql import types as T

from millrace.sources.ddl import DdlError, is_definition, parse


def test_types_and_keys():
    d = parse(
        """create table Line_Item (
            ORDERKEY INT REFERENCES ORDERS(ORDERKEY), Price decimal(12, 2), bare varchar, name VARCHAR(25), flag char(1), note string, day date,
            PRIMARY KEY (ORDERKEY, name), INDEX idx (day), FOREIGN KEY (flag) REFERENCES FLAGS(code), UNIQUE (note)
        );"""
    )
    assert d.name == "Line_Item"
    assert [k for _, k in d.columns] == [T.LongType(), T.DoubleType(), *[T.StringType()] * 4, T.DateType()]
    assert d.primary_key == ("ORDERKEY", "name")
    assert d.references == {"ORDERKEY": ("ORDERS", "ORDERKEY"), "flag": ("FLAGS", "code")}
    assert d.indexes == [("day",), ("note",)]


def test_primary_key_of_a_column_and_no_key_at_all():
    assert parse("CREATE TABLE R (A int PRIMARY KEY, B string NOT NULL)").primary_key == ("A",)
    assert parse("CREATE TABLE R (A int)").primary_key == ()


@pytest.mark.parametrize(
    "text",
    [
        "CREATE TABLE R", "CREATE TABLE R ()", "CREATE TABLE R (A blob)", "CREATE TABLE R (A)", "CREATE TABLE R (A int, a int)",
        "CREATE TABLE R (A int,)", "CREATE TABLE R (A int, PRIMARY KEY (B))", "CREATE TABLE R (A int, PRIMARY KEY)", "CREATE TABLE R (A int))",
        "CREATE TABLE R (A int REFERENCES)", "CREATE TABLE R (A int, FOREIGN KEY (A))",
    ],
)
def test_mistakes(text):
    with pytest.raises(DdlError):
        parse(text)


def test_is_definition():
    assert is_definition("  Create\n TABLE x (a int)")
    assert not is_definition("select 1")
