"""Logical types, their Spark types, coercion and text rendering."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

from .errors import ExecutionError

INTEGER, BIGINT, FLOAT, TEXT, BOOLEAN, BLOB, TIMESTAMP, NULL = "INTEGER", "BIGINT", "FLOAT", "TEXT", "BOOLEAN", "BLOB", "TIMESTAMP", "NULL"
SPARK = {INTEGER: T.IntegerType(), BIGINT: T.LongType(), FLOAT: T.DoubleType(), TEXT: T.StringType(), BOOLEAN: T.BooleanType(), BLOB: T.BinaryType(), TIMESTAMP: T.LongType()}
NUMERIC = frozenset([INTEGER, BIGINT, FLOAT])
ORDERED = NUMERIC | {TIMESTAMP}
#: Bytes of a value in a result, for those of a fixed size.
WIDTHS = {INTEGER: 4, BIGINT: 8, FLOAT: 8, BOOLEAN: 1, TIMESTAMP: 8}
I32, I64 = (-(1 << 31), (1 << 31) - 1), (-(1 << 63), (1 << 63) - 1)


def logical(kind: T.DataType) -> str | None:
    """The logical type of a Spark column; None if the engine has none for it. Timestamps are held as microseconds."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return INTEGER
    if isinstance(kind, T.LongType):
        return BIGINT
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(kind, T.StringType):
        return TEXT
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, T.BinaryType):
        return BLOB
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return TIMESTAMP
    return None


def type_of(value: Any) -> str:
    """The type of a literal's value at run time."""
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, int):
        return BIGINT
    if isinstance(value, (float, Decimal)):
        return FLOAT
    if isinstance(value, (bytes, bytearray)):
        return BLOB
    return TEXT


def _whole(value: Any, bounds: tuple[int, int]) -> int | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")) or not value.is_integer():
            return None
        value = int(value)
    return value if isinstance(value, int) and bounds[0] <= value <= bounds[1] else None


def _float(value: Any) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _exactly(kind: type) -> Callable[[Any], Any]:
    return lambda value: value if isinstance(value, kind) else None


_COERCIONS: dict[str, Callable[[Any], Any]] = {
    INTEGER: lambda v: _whole(v, I32),
    BIGINT: lambda v: _whole(v, I64),
    FLOAT: _float,
    TIMESTAMP: lambda v: None if isinstance(v, float) else _whole(v, I64),
    TEXT: _exactly(str),
    BOOLEAN: _exactly(bool),
    BLOB: lambda v: bytes(v) if isinstance(v, (bytes, bytearray)) else None,
}


def coerce(value: Any, target: str, column: str) -> Any:
    """A non-null value as ``target`` holds it; raises where a write of it is not allowed."""
    out = _COERCIONS[target](value)
    if out is None:
        raise ExecutionError(f"type mismatch for column '{column}': expected {target}, found {type_of(value)}")
    return out


def render(value: Any) -> str:
    """A cell as text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if value != value:
            return "NaN"
        if value in (float("inf"), float("-inf")):
            return "inf" if value > 0 else "-inf"
        text = format(Decimal(repr(value)), "f")
        return text[:-2] if text.endswith(".0") else text
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    return str(value)
