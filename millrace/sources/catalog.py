"""Tables by name, in a memory or a disk mode."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from millrace.operators.layout import buckets_for, drop_stored, store_sorted, stored
from millrace.sources.ddl import TableDefinition
from millrace.sources.keys import join_column
from millrace.sources.pipe import read_pipe
from millrace.sources.scratch import hold, scratch, undo

MODES = ("memory", "disk")


class Catalog:
    """Registers tables as temporary views.

    In memory mode a table is kept after its first use, spilling to disk where memory ends; in disk
    mode every query reads its files again.  Nothing is loaded when a table is registered, but for
    the sorted copies of a disk table with indexes or references: these are made when it is defined,
    one in buckets by each such column, and queries then read the first of them.  What the catalog
    makes goes with ``drop``, ``clear`` or ``millrace.sources.scratch.release``.
    """

    def __init__(self, spark: SparkSession, storage: str = "disk"):
        if storage not in MODES:
            raise ValueError(f"storage is one of {MODES}, not {storage!r}")
        self.spark, self.storage = spark, storage
        self.definitions: dict[str, TableDefinition] = {}
        self.tables: dict[str, DataFrame] = {}
        self.copies: dict[str, dict[str, str]] = {}
        self.id = uuid.uuid4().hex[:8]

    def register(self, name: str, df: DataFrame, definition: TableDefinition | None = None) -> DataFrame:
        self.drop(name)
        if self.storage == "memory":
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
        df.createOrReplaceTempView(name)
        self.tables[name.lower()] = df
        if definition:
            self.definitions[name.lower()] = definition
        hold(f"view {self.id} {name.lower()}", lambda: self._forget(name))
        return df

    def define(self, definition: TableDefinition, path: str) -> DataFrame:
        """Register the pipe-delimited text at ``path`` under a table definition."""
        name, rows = definition.name, read_pipe(self.spark, path, definition.schema)
        columns = definition.sorted_by()
        if self.storage == "memory" or not columns:
            return self.register(name, rows, definition)
        self.drop(name)
        copies = {}
        for column in columns:
            table = f"millrace_{name.lower()}_{column.lower()}_{uuid.uuid4().hex}"
            store_sorted(rows, table, column, buckets_for(rows), scratch(self.spark, "sorted"))
            hold(table, lambda table=table: drop_stored(self.spark, table))
            copies[column.lower()] = table
        self.register(name, stored(self.spark, copies[columns[0].lower()]), definition)
        self.copies[name.lower()] = copies
        return self.tables[name.lower()]

    def sorted_copy(self, name: str, column: str) -> DataFrame:
        """The copy of a disk table that is stored in order of an indexed or referring column."""
        return stored(self.spark, self.copies[name.lower()][column.lower()])

    def join_keys(self, child: str, parent: str) -> list[tuple[str, str]]:
        """The pairs of columns by which a defined table refers to another.

        Its own REFERENCES count first; without any to that table, those of the TPC-H tables do.
        """
        definition = self.definitions[child.lower()]
        columns = {name.lower(): name for name, _ in definition.columns}
        target = self.definitions.get(parent.lower())
        key = target.primary_key[0] if target and target.primary_key else None
        told = [(c, there or key or c) for c, (table, there) in definition.references.items() if table.lower() == parent.lower()]
        implied = join_column(child, parent)
        if not told and implied and implied.lower() in columns:
            told = [(columns[implied.lower()], implied)]
        if not told:
            raise ValueError(f"{child} doesn't refer to {parent}")
        return told

    def parquet(self, name: str, path: str) -> DataFrame:
        return self.register(name, self.spark.read.parquet(path))

    def drop(self, name: str) -> None:
        undo(f"view {self.id} {name.lower()}")
        for table in self.copies.pop(name.lower(), {}).values():
            undo(table)

    def _forget(self, name: str) -> None:
        old = self.tables.pop(name.lower(), None)
        self.definitions.pop(name.lower(), None)
        if old is not None and self.spark.sparkContext._jsc is not None:
            if self.storage == "memory":
                old.unpersist()
            self.spark.catalog.dropTempView(name)

    def clear(self) -> None:
        for name in list(self.tables):
            self.drop(name)
