"""Limits, deadlines, cancellation and roles."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession

from . import types
from .errors import AuthorizationError, ResourceLimitExceeded, StatementCanceled, StatementTimedOut
from .sql import ast

Out = TypeVar("Out")


@dataclass(frozen=True)
class Limits:
    """None is no limit."""

    scan_rows: int | None = None
    sort_rows: int | None = None
    join_rows: int | None = None
    result_rows: int | None = None
    result_bytes: int | None = None
    statements: int | None = None
    timeout_ms: int | None = None

    def of(self, resource: str) -> int | None:
        return {"scan rows": self.scan_rows, "sort rows": self.sort_rows, "join rows": self.join_rows, "query result rows": self.result_rows, "query result bytes": self.result_bytes}[resource]

    def checked(self, resource: str, df: DataFrame) -> DataFrame:
        """``df``, if it has no more rows than the limit; counting stops one row past it."""
        limit = self.of(resource)
        if limit is not None and (n := df.limit(limit + 1).count()) > limit:
            raise ResourceLimitExceeded(resource, n, limit)
        return df


SERVED = Limits(scan_rows=10_000, sort_rows=10_000, join_rows=10_000, result_rows=10_000, result_bytes=4 << 20)


def value_bytes(value: Any, kind: str | None) -> int:
    """Bytes that a value counts for in a result."""
    if value is None:
        return 0
    if isinstance(value, str):
        return len(value.encode())
    if isinstance(value, (bytes, bytearray)):
        return len(value)
    if isinstance(value, bool):
        return 1
    return types.WIDTHS.get(kind or "", 8)


class Cancellation:
    """Stops the statement that it was given to, from any thread."""

    def __init__(self) -> None:
        self._event = threading.Event()
        self._stop: Callable[[], None] | None = None

    def cancel(self) -> None:
        self._event.set()
        if self._stop:
            self._stop()

    @property
    def canceled(self) -> bool:
        return self._event.is_set()


def governed(spark: SparkSession, work: Callable[[], Out], timeout_ms: int | None, cancellation: Cancellation | None) -> Out:
    """Run ``work`` as a job group that a deadline or a cancellation stops."""
    if timeout_ms is None and cancellation is None:
        return work()
    if cancellation and cancellation.canceled:
        raise StatementCanceled
    sc, group, late = spark.sparkContext, f"statement-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        # Jobs that the statement is yet to start are stopped too; no other statement has this group.
        sc._jsc.sc().cancelJobGroupAndFutureJobs(group)

    def expire() -> None:
        late.set()
        stop()

    timer = threading.Timer(timeout_ms / 1000, expire) if timeout_ms is not None else None
    if cancellation:
        cancellation._stop = stop
    sc.setJobGroup(group, "statement", interruptOnCancel=True)
    if timer:
        timer.start()
    try:
        # Work that got done holds, even if the deadline passed at its end.
        return work()
    except Exception:
        if late.is_set():
            raise StatementTimedOut(timeout_ms) from None
        if cancellation and cancellation.canceled:
            raise StatementCanceled from None
        raise
    finally:
        if timer:
            timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


READS = (ast.Select, ast.Begin, ast.Commit, ast.Rollback)
WRITES = (*READS, ast.Insert, ast.Update, ast.Delete)


def authorize(role: str, statement: ast.Statement) -> None:
    """``admin`` may do all, ``writer`` all but definitions, ``reader`` may select, both with transactions."""
    allowed = {"admin": None, "writer": WRITES, "reader": READS}
    if role not in allowed:
        raise AuthorizationError(f"unknown role '{role}'")
    if allowed[role] is not None and not isinstance(statement, allowed[role]):
        raise AuthorizationError(f"role '{role}' may not run {type(statement).__name__}")
