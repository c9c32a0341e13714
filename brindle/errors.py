"""Errors of the engine; messages are part of its contract."""

from __future__ import annotations


class EngineError(Exception):
    """Any error that a statement can end with."""


class SqlSyntaxError(EngineError):
    """The text is not a statement of the dialect."""


class ValidationError(EngineError):
    """A well-formed statement that does not fit the catalog."""


class CatalogError(EngineError):
    """A table that exists already, or doesn't, or whose definition is wrong."""


class ExecutionError(EngineError):
    """An error that only the data shows."""


class PrimaryKeyConflict(ExecutionError):
    def __init__(self, table: str):
        super().__init__(f"primary key conflict on table '{table}'")


class ResourceLimitExceeded(ExecutionError):
    def __init__(self, resource: str, actual: int, limit: int):
        super().__init__(f"resource limit exceeded for {resource}: actual={actual}, limit={limit}")
        self.resource, self.actual, self.limit = resource, actual, limit


class StatementTimedOut(ExecutionError):
    def __init__(self, milliseconds: int):
        super().__init__(f"statement timed out after {milliseconds} ms")


class StatementCanceled(ExecutionError):
    def __init__(self):
        super().__init__("statement canceled: user requested cancellation")


class TransactionError(EngineError):
    """Of the transaction protocol."""


class WriteWriteConflict(TransactionError):
    def __init__(self, key: str, read_ts: int, conflicting: int):
        super().__init__(f"write-write conflict on key '{key}': read_ts={read_ts}, conflicting_commit_ts={conflicting}")


class AuthorizationError(EngineError):
    """The role may not run this statement."""
