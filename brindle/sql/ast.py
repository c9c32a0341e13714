"""Statements and expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Identifier:
    name: str


@dataclass(frozen=True)
class Qualified:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Unary:
    op: str  # NOT, -
    operand: Expr


@dataclass(frozen=True)
class Binary:
    op: str  # = != < <= > >= + - * / AND OR
    left: Expr
    right: Expr


Expr = Literal | Identifier | Qualified | Unary | Binary


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    nullable: bool = True
    default: Literal | None = None


@dataclass(frozen=True)
class OrderItem:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: tuple[str, ...]


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    values: tuple[Expr, ...]


@dataclass(frozen=True)
class Select:
    table: str
    items: tuple[Expr, ...] | None  # None: *
    where: Expr | None = None
    order_by: tuple[OrderItem, ...] = field(default=())
    limit: int | None = None


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Expr], ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class Begin:
    pass


@dataclass(frozen=True)
class Commit:
    pass


@dataclass(frozen=True)
class Rollback:
    pass


Statement = CreateTable | DropTable | Insert | Select | Update | Delete | Begin | Commit | Rollback
