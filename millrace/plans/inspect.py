"""Physical plans and sizes, as Spark reports them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    jvm = df.sparkSession._jvm
    kind = getattr(jvm.org.apache.spark.sql.execution, "ExplainMode").fromString(mode)
    return df._jdf.queryExecution().explainString(kind)


def operators(df: DataFrame) -> list[str]:
    """Names of the physical operators, from the result down."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"^[\s:+*()\d-]*([A-Z]\w+)", text, re.M)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a relation's size: file sizes, less what filters and projections drop."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pushed_filters(df: DataFrame) -> str:
    found = re.findall(r"PushedFilters: \[(.*?)\]", plan_text(df))
    return "; ".join(x for x in found if x)


def read_columns(df: DataFrame) -> list[str]:
    """``ReadSchema`` of each scan."""
    return re.findall(r"ReadSchema: (struct<.*?>)\s*$", plan_text(df), re.M)
