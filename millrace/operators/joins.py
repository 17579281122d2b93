"""Equi-joins: one-pass hash, sort-merge, and left-deep chains of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame

from millrace.plans.inspect import estimated_bytes

#: A side is sent whole to every executor only below this estimate.
BROADCAST_LIMIT = 32 << 20

Keys = Sequence[tuple[str, str]]


def condition(left: DataFrame, right: DataFrame, keys: Keys) -> Column:
    """Equality of each pair of columns; keys are explicit, never taken from shared names."""
    if not keys:
        raise ValueError("an equi-join needs a pair of columns")
    return reduce(lambda a, b: a & b, (left[a] == right[b] for a, b in keys))


def hash_join(left: DataFrame, right: DataFrame, keys: Keys, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Probe a hash table of ``right``.

    Where the estimate of ``right`` is under ``limit`` the table is broadcast and ``left`` doesn't
    move.  Beyond it there is no hint: adaptive execution shuffles both sides, splits skewed
    partitions and still broadcasts if a side turns out small.
    """
    small = estimated_bytes(right) <= limit
    return left.join(right.hint("broadcast") if small else right, condition(left, right, keys))


def merge_join(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Sort-merge join: both sides shuffled and sorted by key, spilling as needed, many to many."""
    return left.join(right.hint("merge"), condition(left, right, keys))


def chain_join(start: DataFrame, *steps: tuple[DataFrame, Keys]) -> DataFrame:
    """Join one table after another by explicit keys; Catalyst and adaptive execution pick the kinds.

    Several pairs in one step all apply, and so close a cycle in the join graph.
    """
    return reduce(lambda joined, step: joined.join(step[0], condition(joined, step[0], step[1])), steps, start)
