"""Expressions to typed Columns, plans to DataFrames.

The dialect's own rules live here: saturating integer arithmetic, division as
floats with an error at zero, errors for values of types that don't compare,
NULL as the greatest value of an ordering, and the byte order of primary keys
where nothing else orders a scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import types
from ..catalog import Table
from ..errors import ExecutionError
from ..sql import ast
from ..types import BIGINT, BLOB, BOOLEAN, FLOAT, INTEGER, NULL, NUMERIC, ORDERED, TEXT, TIMESTAMP
from . import logical

DIVIDE_BY_ZERO = "cannot divide by zero"
LOW, HIGH = types.I64


@dataclass(frozen=True)
class Typed:
    """A Column and the dialect's type of it."""

    column: Column
    type: str


Scope = Callable[[ast.Expr], Typed]


def name(n: str) -> str:
    return "`" + n.replace("`", "``") + "`"


def table_scope(table: Table) -> Scope:
    """Columns of one table, plain or qualified by its name."""

    def find(e: ast.Expr) -> Typed:
        n = e.name if isinstance(e, ast.Identifier) else e.parts[-1]
        column = table.column(n)
        if column is None:
            raise ExecutionError(f"column '{n}' not found in table '{table.name}'")
        return Typed(F.col(name(n)), column.type)

    return find


def named_scope(columns: Mapping[str, Typed]) -> Scope:
    """Columns by what they are called, with dots or without."""

    def find(e: ast.Expr) -> Typed:
        n = e.name if isinstance(e, ast.Identifier) else ".".join(e.parts)
        if n not in columns:
            raise ExecutionError(f"column '{n}' not found")
        return columns[n]

    return find


def _literal(value: object) -> Typed:
    if value is None:
        return Typed(F.lit(None).cast("boolean"), NULL)
    if isinstance(value, bool):
        return Typed(F.lit(value), BOOLEAN)
    if isinstance(value, int):
        return Typed(F.lit(value).cast("long"), BIGINT)
    if isinstance(value, float):
        return Typed(F.lit(value), FLOAT)
    return Typed(F.lit(value), TEXT)


def _mismatch(expected: str, found: str, *operands: Typed) -> Column:
    """An error, but only where a row comes and no operand is NULL."""
    null = F.lit(False)
    for x in operands:
        null = null | x.column.isNull()
    return F.when(null, F.lit(None).cast("boolean")).otherwise(F.raise_error(F.lit(f"type mismatch for column '<expression>': expected {expected}, found {found}")).cast("boolean"))


def lower(e: ast.Expr, scope: Scope) -> Typed:
    """The Column of an expression."""
    match e:
        case ast.Literal(value=value):
            return _literal(value)
        case ast.Identifier() | ast.Qualified():
            return scope(e)
        case ast.Unary(op=op, operand=operand):
            x = lower(operand, scope)
            return _not(x) if op == "NOT" else _negated(x)
        case ast.Binary(op=op, left=left, right=right):
            a, b = lower(left, scope), lower(right, scope)
            if op in ("AND", "OR"):
                a, b = _boolean(a), _boolean(b)
                return Typed(a & b if op == "AND" else a | b, BOOLEAN)
            return _arithmetic(op, a, b) if op in ("+", "-", "*", "/") else _compared(op, a, b)
    raise ExecutionError("unsupported expression")


def _boolean(x: Typed) -> Column:
    return x.column if x.type in (BOOLEAN, NULL) else _mismatch(BOOLEAN, x.type, x)


def _not(x: Typed) -> Typed:
    return Typed(~_boolean(x), BOOLEAN)


def _negated(x: Typed) -> Typed:
    if x.type == FLOAT:
        return Typed(-x.column, FLOAT)
    if x.type == INTEGER:
        return Typed(-x.column.cast("long"), BIGINT)
    if x.type in (BIGINT, TIMESTAMP):
        return Typed(F.coalesce(F.try_subtract(F.lit(0).cast("long"), x.column), F.when(x.column.isNotNull(), F.lit(HIGH))), x.type)
    if x.type == NULL:
        return x
    return Typed(_mismatch(FLOAT, x.type, x), NULL)


def _arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if NULL in (a.type, b.type):
        return Typed(F.lit(None).cast("double" if op == "/" or FLOAT in (a.type, b.type) else "long"), FLOAT if op == "/" or FLOAT in (a.type, b.type) else BIGINT)
    if not {a.type, b.type} <= NUMERIC:
        return Typed(_mismatch(FLOAT, f"{a.type} and {b.type}", a, b), NULL)
    if op == "/":
        x, y = a.column.cast("double"), b.column.cast("double")
        zero = F.raise_error(F.lit(DIVIDE_BY_ZERO)).cast("double")
        return Typed(F.when(x.isNotNull() & (y == 0), zero).otherwise(F.try_divide(x, y)), FLOAT)
    if FLOAT in (a.type, b.type):
        x, y = a.column.cast("double"), b.column.cast("double")
        return Typed(x + y if op == "+" else x - y if op == "-" else x * y, FLOAT)
    x, y = a.column.cast("long"), b.column.cast("long")
    if a.type == b.type == INTEGER:
        # Two 32-bit numbers can't leave 64 bits.
        return Typed(x + y if op == "+" else x - y if op == "-" else x * y, BIGINT)
    tried = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    high = y > 0 if op == "+" else y < 0 if op == "-" else (x < 0) == (y < 0)
    # Without an overflow the first is not null; with a NULL operand both are.
    return Typed(F.coalesce(tried, F.when(x.isNotNull() & y.isNotNull(), F.when(high, F.lit(HIGH)).otherwise(F.lit(LOW)))), BIGINT)


def _compared(op: str, a: Typed, b: Typed) -> Typed:
    if NULL in (a.type, b.type):
        return Typed(F.lit(None).cast("boolean"), BOOLEAN)
    if not ({a.type, b.type} <= ORDERED or (a.type == b.type and a.type in (TEXT, BOOLEAN, BLOB))):
        return Typed(_mismatch(a.type, b.type, a, b), BOOLEAN)
    x, y = a.column, b.column
    return Typed({"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], BOOLEAN)


def output_name(e: ast.Expr, index: int) -> str:
    """What a projected expression is called."""
    if isinstance(e, ast.Identifier):
        return e.name
    return ".".join(e.parts) if isinstance(e, ast.Qualified) else f"expr_{index}"


def byte_key(table: Table) -> list[Column]:
    """Values that compare like the encoded primary keys."""
    out: list[Column] = []
    for k in table.primary_key:
        c, kind = F.col(name(k)), table.column(k).type
        if kind in (TEXT, BLOB):
            out += [F.octet_length(c), c.cast("binary")]
        elif kind == BOOLEAN:
            out.append(c)
        elif kind == FLOAT:
            out += [c < 0, F.abs(c)]
        else:
            out += [c < 0, c]
    return out


def byte_order(table: Table) -> list[Column]:
    """Sort keys that put rows into the byte order of their encoded primary keys."""
    return [c.asc() for c in byte_key(table)]


def order_keys(items: tuple[ast.OrderItem, ...], scope: Scope) -> list[Column]:
    """NULL is the greatest value: last ascending, first descending."""
    columns = [(lower(i.expr, scope).column, i.descending) for i in items]
    return [c.desc_nulls_first() if down else c.asc_nulls_last() for c, down in columns]


def key_filter(scan: logical.PrimaryKeyScan) -> Column:
    """Equalities with the literals as the key columns hold them; a literal that can't be one is an error."""
    out = None
    for k, v in scan.key:
        column = scan.table.column(k)
        if v is None:
            raise ExecutionError(f"missing primary key value for column '{k}'")
        same = F.col(name(k)) == F.lit(types.coerce(v, column.type, k)).cast(types.SPARK[column.type])
        out = same if out is None else out & same
    return out


def frame_scope(df: DataFrame) -> Scope:
    """Columns by their names."""
    return named_scope({f.name: Typed(F.col(name(f.name)), types.logical(f.dataType) or types.NULL) for f in df.schema})


def source_name(node: logical.Node, otherwise: str) -> str:
    """The table that a plan without joins reads."""
    while not isinstance(node, (logical.Scan, logical.PrimaryKeyScan)):
        if isinstance(node, logical.Join):
            return otherwise
        node = node.child
    return node.table.name


def joined(left: DataFrame, right: DataFrame, predicate: ast.Expr, left_name: str, right_name: str) -> DataFrame:
    """Inner join; columns of ``right`` that ``left`` has too come out as ``<right_name>.<column>``."""
    inner = {c: f"__right_{i}" for i, c in enumerate(right.columns)}
    renamed = right.select(*[F.col(name(c)).alias(inner[c]) for c in right.columns])
    kinds = {f.name: types.logical(f.dataType) or types.NULL for f in right.schema}
    scope: dict[str, Typed] = {}
    for c in right.columns:
        scope[c] = scope[f"{right_name}.{c}"] = Typed(F.col(inner[c]), kinds[c])
    for f in left.schema:
        scope[f.name] = scope[f"{left_name}.{f.name}"] = Typed(F.col(name(f.name)), types.logical(f.dataType) or types.NULL)
    out = left.join(renamed, lower(predicate, named_scope(scope)).column, "inner")
    taken = set(left.columns)
    return out.select(*[F.col(name(c)) for c in left.columns], *[F.col(inner[c]).alias(f"{right_name}.{c}" if c in taken else c) for c in right.columns])


def data_frame(node: logical.Node, read: Callable[[Table], DataFrame], checked: Callable[[str, DataFrame], DataFrame] = lambda _, df: df) -> DataFrame:
    """The DataFrame of a SELECT's plan.

    ``checked`` sees the input of scans, sorts and joins by the name of their
    limit. Sorting happens before the projection narrows, so hidden columns can
    order; a limit without an order takes rows in key order, of joins any rows.
    """
    table, sort, limit, items, filters = None, None, None, None, []
    while True:
        match node:
            case logical.Limit(child=child, count=limit):
                node = child
            case logical.Sort(child=child, items=sort):
                node = child
            case logical.Project(child=child, items=items):
                node = child
            case logical.Filter(child=child, predicate=p):
                filters.append(p)
                node = child
            case logical.PrimaryKeyScan(table=table):
                df = read(table).where(key_filter(node))
                break
            case logical.Scan(table=table):
                df = checked("scan rows", read(table))
                break
            case logical.Join(left=left, right=right, predicate=on):
                sides = data_frame(left, read, checked), data_frame(right, read, checked)
                names = source_name(left, "left"), source_name(right, "right")
                df = joined(*(checked("join rows", side) for side in sides), on, names[0], names[1] if names[0] != names[1] else "right")
                break
    scope = table_scope(table) if table else frame_scope(df)
    for p in reversed(filters):
        df = df.where(_boolean(lower(p, scope)))
    if sort:
        df = checked("sort rows", df)
        df = df.orderBy(*order_keys(sort, scope), *(byte_order(table) if limit is not None and table else []))
    elif limit is not None and table:
        df = df.orderBy(*byte_order(table))
    if limit is not None:
        df = df.limit(limit)
    if items is None:
        return df.select(*[F.col(name(c)) for c in (table.names if table else df.columns)])
    return df.select(*[lower(e, scope).column.alias(output_name(e, i)) for i, e in enumerate(items)])
