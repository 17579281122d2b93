"""Results as text: every value followed by a bar."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame


def java_double(x: float) -> str:
    """A double as Java prints it: plain from 0.001 to 10 million, else scientific."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        text = format(Decimal(repr(x)), "f")
        return text if "." in text else text + ".0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    mantissa = "".join(map(str, digits))
    return f"{'-' if sign else ''}{mantissa[0]}.{mantissa[1:] or '0'}E{exponent + len(mantissa) - 1}"


def text_of(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return java_double(value)
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, date):
        return value.isoformat()
    return str(value)


def lines(df: DataFrame) -> Iterator[str]:
    """Lines of a result, fetched a partition at a time; an empty result is one blank line."""
    some = False
    for row in df.toLocalIterator():
        some = True
        yield "".join(text_of(v) + "|" for v in row)
    if not some:
        yield ""
