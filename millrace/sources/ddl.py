"""Table definitions: ``CREATE TABLE name (column type, ..., PRIMARY KEY (...), INDEX ...)``.

Spark's own grammar refuses primary keys, indexes and lengthless varchar in session tables, so the
statement is read here.  Primary keys are kept as metadata; indexes and references of disk tables
make sorted copies (see ``catalog``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from millrace.sources.types import DdlError, spark_type

HEAD = re.compile(r"\s*create\s+table\s+(?:if\s+not\s+exists\s+)?([`\"]?)(\w+)\1\s*\((.*)\)\s*;?\s*$", re.I | re.S)
TOKEN = re.compile(r"\s*(\(|\)|,|[`\"]\w+[`\"]|[^\s(),]+)")
TABLE_LEVEL = {"primary", "foreign", "unique", "index", "key", "constraint", "check"}


@dataclass
class TableDefinition:
    name: str
    columns: list[tuple[str, T.DataType]]
    primary_key: tuple[str, ...] = ()
    references: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    indexes: list[tuple[str, ...]] = field(default_factory=list)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(name, kind) for name, kind in self.columns])

    def sorted_by(self) -> list[str]:
        """The columns that a copy is kept in order of: the first of each index, and those that refer to a table."""
        columns = {name.lower(): name for name, _ in self.columns}
        return list(dict.fromkeys(columns[c.lower()] for c in (*(index[0] for index in self.indexes), *self.references)))


def is_definition(statement: str) -> bool:
    return re.match(r"\s*create\s+table\b", statement, re.I) is not None


def _entries(body: str) -> list[list[str]]:
    """Tokens of each entry between commas outside parentheses."""
    entries, depth, at = [[]], 0, 0
    while at < len(body.rstrip()):
        m = TOKEN.match(body, at)
        token, at = m[1], m.end()
        depth += (token == "(") - (token == ")")
        if depth < 0:
            raise DdlError("unbalanced parentheses")
        if token == "," and depth == 0:
            entries.append([])
        else:
            entries[-1].append(token.strip('`"'))
    if depth:
        raise DdlError("unbalanced parentheses")
    return entries


def _names(tokens: list[str], at: int) -> tuple[str, ...]:
    """Names inside the first parentheses from ``at`` on."""
    try:
        a = tokens.index("(", at)
        return tuple(t for t in tokens[a + 1 : tokens.index(")", a)] if t != ",")
    except ValueError:
        raise DdlError(f"a list of columns is missing in {' '.join(tokens)!r}") from None


def parse(statement: str) -> TableDefinition:
    m = HEAD.match(statement)
    if not m:
        raise DdlError("not a CREATE TABLE statement with a list of columns")
    table = TableDefinition(m[2], [])
    for tokens in _entries(m[3]):
        if not tokens:
            raise DdlError("an empty entry between commas")
        words = [t.lower() for t in tokens]
        if words[0] in TABLE_LEVEL:
            _table_level(table, tokens, words)
        else:
            _column(table, tokens, words)
    names = [name.lower() for name, _ in table.columns]
    if not names:
        raise DdlError("a table needs a column")
    if len(set(names)) < len(names):
        raise DdlError("a column is defined twice")
    for name in (*table.primary_key, *table.references, *(c for index in table.indexes for c in index)):
        if name.lower() not in names:
            raise DdlError(f"no column {name!r}")
    return table


def _table_level(table: TableDefinition, tokens: list[str], words: list[str]) -> None:
    at = 2 if words[0] == "constraint" else 0
    kind = words[at] if at < len(words) else ""
    if kind == "primary":
        table.primary_key = _names(tokens, at)
    elif kind == "foreign":
        target = words.index("references") if "references" in words else None
        if target is None or target + 1 >= len(tokens):
            raise DdlError("FOREIGN KEY without REFERENCES")
        there = _names(tokens, target) if "(" in tokens[target:] else ()
        for k, column in enumerate(_names(tokens, at)):
            table.references[column] = (tokens[target + 1], there[k] if k < len(there) else None)
    elif kind in ("index", "key", "unique"):
        names = _names(tokens, at)
        if not names:
            raise DdlError(f"no columns in {' '.join(tokens)!r}")
        table.indexes.append(names)


def _column(table: TableDefinition, tokens: list[str], words: list[str]) -> None:
    if len(tokens) < 2:
        raise DdlError(f"column {tokens[0]!r} has no type")
    table.columns.append((tokens[0], spark_type(tokens[1])))
    if "primary" in words[2:]:
        table.primary_key = (tokens[0],)
    if "references" in words[2:]:
        at = words.index("references", 2)
        if at + 1 >= len(tokens):
            raise DdlError("REFERENCES without a table")
        there = _names(tokens, at) if "(" in tokens[at:] else ()
        table.references[tokens[0]] = (tokens[at + 1], there[0] if there else None)
