"""Sorts, limits and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A name, or a name and whether it ascends.
Key = str | tuple[str, bool]


def ordered(df: DataFrame, *keys: Key) -> DataFrame:
    """Total order by any number of keys: a range shuffle and sorts that spill."""
    return df.orderBy(*_columns(keys))


def _columns(keys: Sequence[Key]) -> list:
    split = [(k, True) if isinstance(k, str) else k for k in keys]
    return [F.col(name).asc() if up else F.col(name).desc() for name, up in split]


def limited(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of what stands; negative counts are refused."""
    if n < 0:
        raise ValueError("LIMIT must not be negative")
    return df.limit(n)


def top(df: DataFrame, n: int, *keys: Key) -> DataFrame:
    """ORDER BY with LIMIT: every task keeps n rows, and only those meet."""
    return limited(ordered(df, *keys), n)
