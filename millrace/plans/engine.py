"""Statements to DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.statements import bare, split
from millrace.sources import ddl
from millrace.sources.catalog import Catalog

QUERY = re.compile(r"[\s(]*(select|with)\b", re.I)


class UnsupportedStatement(ValueError):
    """A statement that is neither a table definition nor a query."""


class Engine:
    """Runs table definitions and queries.

    ``CREATE TABLE t (...)`` binds ``<data_dir>/t<extension>``, pipe-delimited text; ``parquet`` and
    ``register`` add other tables.  Queries are Spark SQL over these, planned by Catalyst; results
    are lazy, and errors are Spark's own.  Every query stands alone: nothing leaks from the last.
    """

    def __init__(self, spark: SparkSession, data_dir: str = "data", storage: str = "disk", extension: str = ".csv"):
        self.spark, self.data_dir, self.extension = spark, data_dir.rstrip("/"), extension
        self.catalog = Catalog(spark, storage)

    def execute(self, statement: str) -> DataFrame | None:
        """The result of one query, or None for a table definition; a final semicolon and comments are allowed."""
        whole, rest = split(statement)
        if len(whole) + bool(bare(rest)) > 1:
            raise UnsupportedStatement("one statement at a time; `run` takes several")
        statement = whole[0] if whole else bare(statement)
        if ddl.is_definition(statement):
            definition = ddl.parse(statement)
            self.catalog.define(definition, f"{self.data_dir}/{definition.name}{self.extension}")
            return None
        if QUERY.match(statement):
            return self.spark.sql(statement)
        raise UnsupportedStatement(f"only CREATE TABLE and SELECT are supported: {statement[:60]!r}")

    def run(self, script: str) -> list[DataFrame | None]:
        """The results of a script's statements, in order."""
        whole, rest = split(script)
        return [self.execute(s) for s in (*whole, *filter(None, [bare(rest)]))]

    def parquet(self, name: str, path: str | None = None) -> DataFrame:
        return self.catalog.parquet(name, path or f"{self.data_dir}/{name}.parquet")

    def register(self, name: str, df: DataFrame) -> DataFrame:
        return self.catalog.register(name, df)

    def explain(self, query: str, mode: str = "formatted") -> str:
        from millrace.plans.inspect import plan_text

        return plan_text(self.spark.sql(query.strip().rstrip(";")), mode)
