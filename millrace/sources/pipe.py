"""Pipe-delimited text: a value between bars, no header, no quoting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_pipe(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed rows of a file or folder.

    A trailing bar and missing trailing fields are allowed, an empty field is NULL, quotes and
    spaces are kept, blank lines are skipped.  A row with a value beyond the last column fails the
    query, and so does a malformed number or date: fields are read as text and cast under ANSI rules.
    Only the columns that a query names are cast.
    """
    n = len(schema)
    fields = spark.read.text(path).where(F.trim("value") != "").select("value", F.split("value", r"\|", -1).alias("fields"))
    beyond = F.array_join(F.slice("fields", n + 1, F.greatest(F.size("fields") - n, F.lit(0))), "")
    too_long = F.raise_error(F.concat(F.lit(f"a row has more than {n} fields: "), F.substring("value", 1, 200))).cast("boolean")
    checked = fields.where(F.when((F.size("fields") > n) & (beyond != ""), too_long).otherwise(True))
    return checked.select(*[F.nullif(F.get("fields", F.lit(k)), F.lit("")).cast(f.dataType).alias(f.name) for k, f in enumerate(schema)])


def pipe_lines(df: DataFrame, column: str = "line") -> DataFrame:
    """One text column: every value followed by a bar, NULL as nothing."""
    return df.select(F.concat(F.lit(""), *[part for c in df.columns for part in (rendered(df[f"`{c}`"]), F.lit("|"))]).alias(column))


def rendered(value: Column) -> Column:
    """A value as text; Spark writes doubles as Java does."""
    return F.coalesce(value.cast("string"), F.lit(""))


def write_pipe(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``df`` as pipe-delimited text, in as many files as it has partitions."""
    pipe_lines(df).write.mode(mode).text(path)
