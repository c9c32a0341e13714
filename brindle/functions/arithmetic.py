"""Arithmetic and comparison as the dialect does them, on plain Columns."""

from __future__ import annotations

from pyspark.sql import Column

from ..plans import lowering
from ..plans.lowering import Typed
from ..types import BIGINT, FLOAT


def saturating_add(a: Column, b: Column) -> Column:
    """Sum of two longs, held at the ends of the range; null if either is."""
    return lowering._arithmetic("+", Typed(a, BIGINT), Typed(b, BIGINT)).column


def saturating_subtract(a: Column, b: Column) -> Column:
    return lowering._arithmetic("-", Typed(a, BIGINT), Typed(b, BIGINT)).column


def saturating_multiply(a: Column, b: Column) -> Column:
    return lowering._arithmetic("*", Typed(a, BIGINT), Typed(b, BIGINT)).column


def divide(a: Column, b: Column) -> Column:
    """Quotient as a double; an error for a divisor of zero, unless the dividend is null."""
    return lowering._arithmetic("/", Typed(a, FLOAT), Typed(b, FLOAT)).column


def negate(a: Column) -> Column:
    """Of a long, held at the end of the range."""
    return lowering._negated(Typed(a, BIGINT)).column


def compare(op: str, a: Column, b: Column, kind: str = BIGINT) -> Column:
    """``= != < <= > >=`` of two values of one type."""
    return lowering._compared(op, Typed(a, kind), Typed(b, kind)).column
