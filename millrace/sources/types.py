"""The types of table definitions and what they become in Spark."""

from __future__ import annotations

from pyspark.sql import types as T

#: The type names of table definitions. Lengths and precisions are not kept.
KINDS: dict[str, T.DataType] = {
    "int": T.LongType(),
    "decimal": T.DoubleType(),
    "string": T.StringType(),
    "varchar": T.StringType(),
    "char": T.StringType(),
    "date": T.DateType(),
}


class DdlError(ValueError):
    """A table definition that cannot be understood."""


def spark_type(name: str) -> T.DataType:
    """64-bit integers, doubles for decimals, plain strings, dates; anything else is refused."""
    try:
        return KINDS[name.lower()]
    except KeyError:
        raise DdlError(f"unsupported type {name!r}; known are {', '.join(KINDS)}") from None
