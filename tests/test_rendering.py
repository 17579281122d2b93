import datetime
import io

import pytest

from millrace import Engine
from millrace.functions.rendering import java_double, lines
from millrace.repl import message, repl
from millrace.sources.pipe import pipe_lines, write_pipe


@pytest.mark.parametrize(
    ("x", "text"),
    [
        (0.0, "0.0"), (-0.0, "-0.0"), (1.0, "1.0"), (-2.5, "-2.5"), (0.001, "0.001"), (9999999.0, "9999999.0"), (1e7, "1.0E7"), (1.25e10, "1.25E10"),
        (0.00012, "1.2E-4"), (-123456789.5, "-1.234567895E8"), (float("nan"), "NaN"), (float("inf"), "Infinity"), (float("-inf"), "-Infinity"),
    ],
)
def test_doubles(spark, x, text):
    assert java_double(x) == text
    assert spark.createDataFrame([(x,)], "x double").selectExpr("cast(x as string)").first()[0] == text


def test_lines(spark):
    df = spark.createDataFrame([(1, "a", 2.0, datetime.date(1995, 1, 2), None, True)], "a long, b string, c double, d date, e string, f boolean")
    assert list(lines(df)) == ["1|a|2.0|1995-01-02||true|"]
    assert [r[0] for r in pipe_lines(df).collect()] == ["1|a|2.0|1995-01-02||true|"]


def test_empty_results(spark):
    empty = spark.createDataFrame([], "a double")
    assert list(lines(empty)) == [""]
    assert list(lines(empty.selectExpr("sum(a)", "count(*)"))) == ["|0|"]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", 2.5), (2, None, None)], "A long, B string, C double")
    write_pipe(df, str(tmp_path / "T.csv"))
    engine = Engine(spark, str(tmp_path))
    engine.execute("CREATE TABLE T (A int, B varchar(10), C decimal)")
    assert [tuple(r) for r in engine.execute("SELECT * FROM T ORDER BY A").collect()] == [(1, "a b", 2.5), (2, None, None)]


def test_repl(spark, tmp_path):
    (tmp_path / "R.csv").write_text("1|x\n2|y\n")
    out = io.StringIO()
    text = "CREATE TABLE R (A int,\nB string);\nSELECT A, B FROM R\nORDER BY A DESC;\nSELECT nothing FROM R;\nSELECT max(A) FROM R;\nexit;\nSELECT 1;\n"
    repl(Engine(spark, str(tmp_path)), io.StringIO(text), out)
    got = out.getvalue().split("$>")
    assert got[1] == ""
    assert got[2] == "2|y|\n1|x|\n"
    assert "UNRESOLVED_COLUMN" in got[3]
    assert got[4] == "2|\n"
    assert got[5:] == [""]


def said(spark, text, **streams):
    out = io.StringIO()
    repl(Engine(spark), io.StringIO(text), out, **streams)
    return out.getvalue().replace("$>", "").splitlines()


@pytest.mark.parametrize(
    ("text", "lines"),
    [
        ("SELECT 1 AS a -- note\n, 2 AS b;\n", ["1|2|"]),
        ("SELECT 1; SELECT 2;\n", ["1|", "2|"]),
        ("SELECT 1;SELECT\n2\n;SELECT 3;\n", ["1|", "2|", "3|"]),
        ("SELECT ';' AS a, \"x;y\" AS b;\n", [";|x;y|"]),
        ("SELECT 'it\\'s; so' AS a;\n", ["it's; so|"]),
        ("SELECT 1 AS `a;b`;\n", ["1|"]),
        ("SELECT /* one; /* two */ ; */ 1 -- three;\n;\n", ["1|"]),
        ("-- only a comment;\n;; /* nothing */ ;\nSELECT 4;\n", ["4|"]),
        ("SELECT 'a\nb' AS a;\n", ["a", "b|"]),
        ("SELECT 5;\nSELECT 6\n", ["5|", "unfinished statement: 'SELECT 6'"]),
        ("SELECT 7; -- the end", ["7|"]),
        ("EXIT; SELECT 8;\n", []),
    ],
)
def test_statements_of_a_script(spark, text, lines):
    assert said(spark, text) == lines


def test_errors_say_something(spark):
    assert message(ValueError("\n\n  first\nsecond")) == "first" and message(KeyError()) == "KeyError"
    got = said(spark, "SELECT 1 +;\nDROP TABLE x;\nCREATE TABLE T (A blob);\nSELECT 1;\n")
    assert len(got) == 4 and all(got) and "PARSE_SYNTAX_ERROR" in got[0] and "unsupported type" in got[2] and got[3] == "1|"


def test_times(spark):
    times = io.StringIO()
    said(spark, "SELECT 1; SELECT 2;\n", times=times)
    assert len(times.getvalue().splitlines()) == 2 and times.getvalue().endswith(" ms\n")


def test_one_statement_or_several(spark):
    engine = Engine(spark)
    assert engine.execute("SELECT 1 AS a; -- done").collect()[0]["a"] == 1
    assert engine.execute("SELECT /*+ COALESCE(1) */ 2 AS a").collect()[0]["a"] == 2
    with pytest.raises(ValueError, match="one statement"):
        engine.execute("SELECT 1; SELECT 2")
    assert [df.collect()[0][0] for df in engine.run("SELECT 1; SELECT 2")] == [1, 2]
