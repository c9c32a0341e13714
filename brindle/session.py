"""Sessions: statements, transactions, limits, roles, EXPLAIN."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import types
from .catalog import Catalog, Table
from .catalog import Column as TableColumn
from .errors import EngineError, ExecutionError, PrimaryKeyConflict, ResourceLimitExceeded, TransactionError
from .governance import Cancellation, Limits, authorize, governed, value_bytes
from .plans import logical
from .plans.lowering import Typed, byte_key, data_frame, lower, name, table_scope
from .sql import ast, parse, validate
from .sql.validator import definition
from .store import COMMIT, SEQUENCE, TOMBSTONE, FileSet, Store


@dataclass
class QueryResult:
    """Column names and rows in order; names may repeat."""

    columns: list[str]
    rows: list[tuple]

    def text(self) -> list[list[str]]:
        return [[types.render(v) for v in row] for row in self.rows]


@dataclass
class AffectedRows:
    count: int


@dataclass
class TransactionState:
    state: str  # begun, committed, rolled_back


Result = QueryResult | AffectedRows | TransactionState


@dataclass
class _Transaction:
    read_ts: int
    staged: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    #: Rows of single-row inserts, kept here until a read or the commit.
    buffered: dict[str, list[tuple]] = field(default_factory=dict)
    sequence: int = 0

    def next(self) -> int:
        self.sequence += 1
        return self.sequence


class _Tables(Catalog):
    """A store's catalog and tables that a session reads as they are."""

    def __init__(self, store: Store | None):
        super().__init__()
        self.store = store

    def get_table(self, name: str) -> Table | None:
        return super().get_table(name) or (self.store.catalog.get_table(name) if self.store else None)


class Session:
    """One client. Statements run one at a time; a transaction spans several."""

    def __init__(self, spark: SparkSession, store: Store | None = None, limits: Limits | None = None, role: str = "admin"):
        self.spark, self.store, self.limits, self.role = spark, store, limits or Limits(), role
        self.catalog = _Tables(store)
        self._attached: dict[str, DataFrame] = {}
        self._tx: _Transaction | None = None

    # Tables that are read only.

    def attach(self, table: str, df: DataFrame, primary_key: list[str]) -> Table:
        """Let ``df`` be read as a table. Timestamps become microseconds; columns of types that the engine lacks are left out."""
        columns, selected = [], []
        for f in df.schema:
            kind = types.logical(f.dataType)
            if kind is None:
                continue
            columns.append(TableColumn(f.name, kind, f.name not in primary_key))
            c = F.col(name(f.name))
            selected.append(F.unix_micros(c.cast("timestamp")).alias(f.name) if kind == types.TIMESTAMP else c.cast(types.SPARK[kind]).alias(f.name))
        made = self.catalog.create_table(Table(table, tuple(columns), tuple(primary_key)))
        self._attached[table] = df.select(*selected)
        return made

    def read(self, table: Table) -> DataFrame:
        """The table as this session sees it now."""
        if table.name in self._attached:
            return self._attached[table.name]
        tx = self._tx
        return self.store.snapshot(table, tx.read_ts if tx else None, self._staged(table) if tx else None)

    def as_of(self, table: str, ts: int) -> DataFrame:
        """A stored table at an earlier timestamp."""
        return self.store.snapshot(self._stored(table), ts)

    def _stored(self, table: str) -> Table:
        found = self.catalog.get_table(table)
        if found is None:
            raise ExecutionError(f"table '{table}' not found")
        if table in self._attached or self.store is None:
            raise ExecutionError(f"table '{table}' is read only")
        return found

    # Statements.

    @property
    def in_transaction(self) -> bool:
        return self._tx is not None

    def frame(self, text: str) -> DataFrame:
        """The lazy DataFrame of one SELECT."""
        (statement,) = parse(text)
        if not isinstance(statement, ast.Select):
            raise ExecutionError("only SELECT has a DataFrame")
        authorize(self.role, statement)
        validate(self.catalog, statement)
        return data_frame(self._plan(statement), self.read, self.limits.checked)

    def explain(self, text: str, catalyst: bool = False) -> str:
        """Plans of all statements, none of which runs."""
        out = []
        for s in parse(text):
            authorize(self.role, s)
            validate(self.catalog, s)
            if isinstance(s, ast.Select):
                plan = self._plan(s)
                out.append(logical.tree(plan))
                if catalyst:
                    out.append(data_frame(plan, self.read)._jdf.queryExecution().toString())
            elif isinstance(s, (ast.Update, ast.Delete)):
                table = self.catalog.get_table(s.table)
                below = logical.Scan(table) if s.where is None else logical.Filter(logical.Scan(table), logical.fold(s.where))
                out.append(f"{type(s).__name__} table={s.table}\n{logical.tree(below, 1)}")
            else:
                out.append(type(s).__name__ + "".join(f" table={getattr(s, a)}" for a in ("table", "name") if hasattr(s, a)))
        return "\n".join(out)

    def _plan(self, s: ast.Select) -> logical.Node:
        return logical.physical(logical.optimize(logical.build(self.catalog.get_table(s.table), s)))

    def sql(self, text: str, timeout_ms: int | None = None, cancellation: Cancellation | None = None) -> Result:
        """Run a script; the result of its last statement."""
        return self.script(text, timeout_ms, cancellation)[-1]

    def script(self, text: str, timeout_ms: int | None = None, cancellation: Cancellation | None = None) -> list[Result]:
        """Run the statements of a script one after the other. All are authorised before the first runs."""
        statements = parse(text)
        for s in statements:
            authorize(self.role, s)
        if self.limits.statements is not None and len(statements) > self.limits.statements:
            raise ResourceLimitExceeded("statements", len(statements), self.limits.statements)
        timeout = timeout_ms if timeout_ms is not None else self.limits.timeout_ms
        return [self._run(s, timeout, cancellation) for s in statements]

    def _run(self, s: ast.Statement, timeout_ms: int | None, cancellation: Cancellation | None) -> Result:
        from .errors import StatementCanceled, StatementTimedOut

        if self.store and not isinstance(s, ast.Begin):
            self.store.refresh()
        try:
            return governed(self.spark, lambda: self._execute(s), timeout_ms, cancellation)
        except (StatementCanceled, StatementTimedOut):
            self._end()
            raise

    def _execute(self, s: ast.Statement) -> Result:
        match s:
            case ast.Begin():
                if self._tx:
                    raise TransactionError("transaction already active")
                self._tx = _Transaction(self.store.pin() if self.store else 0)
                return TransactionState("begun")
            case ast.Commit():
                self._need()
                try:
                    self._commit()
                finally:
                    self._end(committed=True)
                return TransactionState("committed")
            case ast.Rollback():
                self._need()
                self._end()
                return TransactionState("rolled_back")
            case ast.CreateTable() | ast.DropTable():
                if self._tx:
                    raise TransactionError("DDL in explicit transaction is not supported yet")
                validate(self.catalog, s)
                if isinstance(s, ast.CreateTable):
                    self._writable().create_table(definition(s))
                else:
                    self._stored(s.name)
                    self.store.drop_table(s.name)
                return AffectedRows(0)
            case ast.Select():
                validate(self.catalog, s)
                with _translated():
                    return self._collect(data_frame(self._plan(s), self.read, self.limits.checked))
        validate(self.catalog, s)
        with self._writing(), _translated():
            table = self._stored(s.table)
            match s:
                case ast.Insert():
                    return AffectedRows(self._insert(table, s))
                case ast.Update():
                    return AffectedRows(self._update(table, s))
                case ast.Delete():
                    return AffectedRows(self._delete(table, s))
        raise ExecutionError("unsupported statement")

    def _writable(self) -> Store:
        if self.store is None:
            raise ExecutionError("this session has no store")
        return self.store

    def _collect(self, df: DataFrame) -> QueryResult:
        limit = self.limits.result_rows
        rows = [tuple(r) for r in (df if limit is None else df.limit(limit + 1)).collect()]
        if limit is not None and len(rows) > limit:
            raise ResourceLimitExceeded("query result rows", len(rows), limit)
        most = self.limits.result_bytes
        if most is not None:
            kinds = [types.logical(f.dataType) for f in df.schema]
            size = sum(value_bytes(v, k) for row in rows for v, k in zip(row, kinds))
            if size > most:
                raise ResourceLimitExceeded("query result bytes", size, most)
        return QueryResult(df.columns, [tuple(bytes(v) if isinstance(v, bytearray) else v for v in row) for row in rows])

    # Transactions.

    def _need(self) -> None:
        if not self._tx:
            raise TransactionError("no active transaction")

    def _end(self, committed: bool = False) -> None:
        if self._tx and self.store:
            self.store.unpin(self._tx.read_ts)
            if not committed:
                self.store.metrics["rolled_back"] += 1
        self._tx = None

    def abort(self) -> None:
        """Give up an open transaction, if there is one."""
        self._end()

    @contextmanager
    def _writing(self) -> Iterator[None]:
        """An open transaction, or one for this statement alone."""
        if self._tx:
            yield
            return
        self._tx = _Transaction(self._writable().pin())
        done = False
        try:
            yield
            self._commit()
            done = True
        finally:
            self._end(committed=done)

    def _commit(self) -> None:
        tx = self._tx
        for table, rows in tx.buffered.items():
            found = self._stored(table)
            tx.staged.setdefault(table, []).append((self.store.stage(found, self._frame_of(found, rows)), len(rows)))
        tx.buffered = {}
        if tx.staged:
            self.store.commit(tx.read_ts, tx.staged)

    def _frame_of(self, table: Table, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, self.store.version_schema(table))

    def _staged(self, table: Table) -> DataFrame | None:
        out = None
        if self._tx.staged.get(table.name):
            out = self.store.versions(table, [FileSet(p, 0, n) for p, n in self._tx.staged[table.name]]).drop(COMMIT)
        if self._tx.buffered.get(table.name):
            more = self._frame_of(table, self._tx.buffered[table.name])
            out = more if out is None else out.unionByName(more)
        return out

    # Writes.

    def _insert(self, table: Table, s: ast.Insert) -> int:
        given = dict(zip(s.columns, (self._constant(e) for e in s.values)))
        row = []
        for c in table.columns:
            value = given[c.name] if c.name in given else c.default
            if value is None:
                if c.name in table.primary_key and c.name not in given:
                    raise ExecutionError(f"missing primary key value for column '{c.name}'")
                if not c.nullable:
                    raise ExecutionError(f"NULL is not allowed for column '{c.name}'")
            row.append(None if value is None else types.coerce(value, c.type, c.name))
        key = [row[table.names.index(k)] for k in table.primary_key]
        same = None
        for k, v in zip(table.primary_key, key):
            this = F.col(name(k)) == F.lit(v).cast(types.SPARK[table.column(k).type])
            same = this if same is None else same & this
        if not self.read(table).where(same).isEmpty():
            raise PrimaryKeyConflict(table.name)
        self._tx.buffered.setdefault(table.name, []).append((*row, self._tx.next(), False))
        return 1

    def _constant(self, e: ast.Expr) -> Any:
        folded = logical.fold(e)
        if isinstance(folded, ast.Literal):
            return folded.value

        def none(x: ast.Expr) -> Typed:
            raise ExecutionError(f"column '{logical.show(x)}' not found")

        return self.spark.range(1).select(lower(folded, none).column.alias("v")).first()[0]

    def _matched(self, table: Table, where: ast.Expr | None) -> DataFrame:
        df = self.read(table)
        return df if where is None else df.where(lower(logical.fold(where), table_scope(table)).column)

    def _update(self, table: Table, s: ast.Update) -> int:
        """All assignments read the old row; new keys may only take places that are free when their row comes in key order."""
        scope, new = table_scope(table), dict(s.assignments)
        rows = self._matched(table, s.where)
        columns = [(_stored_as(lower(logical.fold(new[c.name]), scope), c) if c.name in new else F.col(name(c.name))).alias(c.name) for c in table.columns]
        if not set(table.primary_key) & set(new):
            versions = rows.select(*columns, F.lit(self._tx.next()).cast("long").alias(SEQUENCE), F.lit(False).alias(TOMBSTONE))
            return self._stage(table, versions)
        old = [F.col(name(k)).alias(f"__old_{i}") for i, k in enumerate(table.primary_key)]
        rank = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(byte_key(table))]).alias("__rank")
        moved = rows.select(*columns, *old, rank)
        if self._key_conflict(table, moved):
            raise PrimaryKeyConflict(table.name)
        first, second = self._tx.next(), self._tx.next()
        gone = moved.select(*[F.col(f"__old_{table.primary_key.index(c.name)}").alias(c.name) if c.name in table.primary_key else F.lit(None).cast(types.SPARK[c.type]).alias(c.name) for c in table.columns], F.lit(first).cast("long").alias(SEQUENCE), F.lit(True).alias(TOMBSTONE))
        here = moved.select(*[F.col(name(c)) for c in table.names], F.lit(second).cast("long").alias(SEQUENCE), F.lit(False).alias(TOMBSTONE))
        return self._stage(table, gone.unionByName(here)) // 2

    def _key_conflict(self, table: Table, moved: DataFrame) -> bool:
        keys = [F.col(name(k)) for k in table.primary_key]
        if not moved.groupBy(*keys).count().where("count > 1").isEmpty():
            return True
        stays = None
        for i, k in enumerate(table.primary_key):
            this = F.col(name(k)) == F.col(f"__old_{i}")
            stays = this if stays is None else stays & this
        wanted = moved.where(~stays).select(*[k.alias(f"__key_{i}") for i, k in enumerate(keys)], F.col("__rank").alias("__mover"))
        live = self.read(table).select(*[k.alias(f"__key_{i}") for i, k in enumerate(keys)])
        places = [f"__key_{i}" for i in range(len(keys))]
        owners = moved.select(*[F.col(f"__old_{i}").alias(p) for i, p in enumerate(places)], F.col("__rank").alias("__owner"), stays.alias("__stays"))
        taken = wanted.join(live, places).join(owners, places, "left")
        return not taken.where(F.col("__owner").isNull() | F.col("__stays") | (F.col("__owner") > F.col("__mover"))).isEmpty()

    def _delete(self, table: Table, s: ast.Delete) -> int:
        rows = self._matched(table, s.where)
        gone = rows.select(*[F.col(name(c.name)) if c.name in table.primary_key else F.lit(None).cast(types.SPARK[c.type]).alias(c.name) for c in table.columns], F.lit(self._tx.next()).cast("long").alias(SEQUENCE), F.lit(True).alias(TOMBSTONE))
        return self._stage(table, gone)

    def _stage(self, table: Table, versions: DataFrame) -> int:
        path = self.store.stage(table, versions)
        n = self.store.versions(table, [FileSet(path, 0, 0)]).count()
        if n:
            self._tx.staged.setdefault(table.name, []).append((path, n))
        return n


def _stored_as(x: Typed, column: TableColumn) -> Column:
    """A value as the column holds it, or an error for the row."""
    kind = types.SPARK[column.type]
    c = x.column
    if x.type != types.NULL and x.type != column.type:
        fine = F.lit(True)
        if column.type in (types.INTEGER, types.BIGINT, types.TIMESTAMP):
            low, high = types.I32 if column.type == types.INTEGER else types.I64
            if x.type == types.FLOAT:
                fine = (c == F.floor(c)) & (c >= float(low)) & (c < float(high) + 1)
            elif column.type == types.INTEGER:
                fine = (c >= low) & (c <= high)
        wrong = F.raise_error(F.lit(f"type mismatch for column '{column.name}': expected {column.type}, found {x.type}"))
        c = F.when(c.isNull() | fine, c).otherwise(wrong.cast(_spark_type(x.type)))
    c = c.cast(kind) if column.type != types.INTEGER or x.type == types.INTEGER else c.try_cast("int")
    if not column.nullable:
        c = F.coalesce(c, F.raise_error(F.lit(f"NULL is not allowed for column '{column.name}'")).cast(kind))
    return c


def _spark_type(kind: str):
    return types.SPARK.get(kind, types.SPARK[types.BIGINT])


@contextmanager
def _translated() -> Iterator[None]:
    """Errors that a row raised, as the engine's own."""
    try:
        yield
    except EngineError:
        raise
    except PySparkException as e:
        said = str(e)
        found = re.search(r"\[USER_RAISED_EXCEPTION\] (.*?)(?: SQLSTATE: \w+|\n|$)", said)
        if found:
            raise ExecutionError(found[1].strip()) from None
        if "DIVIDE_BY_ZERO" in said:
            raise ExecutionError("cannot divide by zero") from None
        raise
