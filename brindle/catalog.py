"""Table descriptors and the catalog that holds them."""

from __future__ import annotations

import threading
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from . import types
from .errors import CatalogError


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    default: Any = None
    has_default: bool = False


@dataclass(frozen=True)
class Table:
    """Name, columns in declared order, primary key."""

    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...]

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, types.SPARK[c.type], c.nullable, {"logical_type": c.type}) for c in self.columns])

    def check(self) -> None:
        """Raise unless this is a proper definition."""
        if not self.name:
            raise CatalogError("table name cannot be empty")
        if not self.columns:
            raise CatalogError("table must define at least one column")
        seen: set[str] = set()
        for c in self.columns:
            if not c.name.strip():
                raise CatalogError(f"invalid column '{c.name}': column name cannot be empty")
            if c.name in seen:
                raise CatalogError(f"column '{c.name}' is duplicated")
            seen.add(c.name)
            if c.has_default:
                self._check_default(c)
        if not self.primary_key:
            raise CatalogError("primary key must contain at least one column")
        named: set[str] = set()
        for k in self.primary_key:
            c = self.column(k)
            if c is None:
                raise CatalogError(f"primary key column '{k}' does not exist in table")
            if c.nullable:
                raise CatalogError(f"primary key column '{k}' cannot be nullable")
            if k in named:
                raise CatalogError(f"column '{k}' is duplicated")
            named.add(k)

    @staticmethod
    def _check_default(c: Column) -> None:
        if c.default is None:
            if not c.nullable:
                raise CatalogError(f"invalid column '{c.name}': NULL default is not allowed")
            return
        types.coerce(c.default, c.type, c.name)

    def to_json(self) -> dict:
        return {"name": self.name, "primary_key": list(self.primary_key), "columns": [{"name": c.name, "type": c.type, "nullable": c.nullable, "default": c.default, "has_default": c.has_default} for c in self.columns]}

    @classmethod
    def from_json(cls, said: dict) -> Table:
        return cls(said["name"], tuple(Column(**c) for c in said["columns"]), tuple(said["primary_key"]))


class Catalog:
    """Tables by name; changes are seen at once by all sessions that share it."""

    def __init__(self, tables: list[Table] | None = None):
        self._tables = {t.name: t for t in tables or []}
        self._lock = threading.RLock()

    def create_table(self, table: Table) -> Table:
        table = Table(table.name.strip(), table.columns, table.primary_key)
        table.check()
        with self._lock:
            if table.name in self._tables:
                raise CatalogError(f"table '{table.name}' already exists")
            self._tables[table.name] = table
        return table

    def drop_table(self, name: str) -> Table:
        with self._lock:
            if name.strip() not in self._tables:
                raise CatalogError(f"table '{name}' was not found")
            return self._tables.pop(name.strip())

    def get_table(self, name: str) -> Table | None:
        return self._tables.get(name.strip())

    def list_tables(self) -> list[Table]:
        return [self._tables[n] for n in self.list_table_names()]

    def list_table_names(self) -> list[str]:
        return sorted(self._tables)

    def refresh(self, tables: list[Table]) -> None:
        """Take over what a store holds."""
        with self._lock:
            self._tables = {t.name: t for t in tables}
