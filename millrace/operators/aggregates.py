"""Grouped and global aggregates with SQL semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(*values: Column) -> Column:
    """SUM in double; several arguments are added together."""
    out = values[0].cast("double")
    for v in values[1:]:
        out = out + v.cast("double")
    return F.sum(out)


def mean(value: Column) -> Column:
    return F.avg(value.cast("double"))


def counted(value: Column | None = None) -> Column:
    """COUNT(*) or, of a value, COUNT of those not null."""
    return F.count(F.lit(1)) if value is None else F.count(value)


def grouped(df: DataFrame, keys: Sequence[str | Column], **aggregates: Column) -> DataFrame:
    """Any number of keys, none for a global aggregate.  Partial sums are made before the shuffle."""
    named = [value.alias(name) for name, value in aggregates.items()]
    return df.groupBy(*keys).agg(*named) if keys else df.agg(*named)


def counted_where(condition: Column) -> Column:
    """SUM(CASE WHEN condition THEN 1 ELSE 0 END)."""
    return F.sum(F.when(condition, 1).otherwise(0))
