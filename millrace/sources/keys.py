"""Foreign keys of the TPC-H tables, for documentation and checks; joins take their keys from the query."""

from __future__ import annotations

#: Child table -> {parent table: shared column}.
TPCH_REFERENCES: dict[str, dict[str, str]] = {
    "ORDERS": {"CUSTOMER": "CUSTKEY"},
    "LINEITEM": {"ORDERS": "ORDERKEY", "PART": "PARTKEY", "SUPPLIER": "SUPPKEY"},
    "SUPPLIER": {"NATION": "NATIONKEY"},
    "NATION": {"REGION": "REGIONKEY"},
    "PARTSUPP": {"PART": "PARTKEY", "SUPPLIER": "SUPPKEY"},
    "CUSTOMER": {"NATION": "NATIONKEY"},
}


def join_column(child: str, parent: str) -> str | None:
    """The column that ``child`` shares with ``parent``, if it refers to it."""
    return TPCH_REFERENCES.get(child.upper(), {}).get(parent.upper())
