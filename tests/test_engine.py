"""Sessions on a store: values, writes, transactions, limits."""

import threading
import time

import pytest

from brindle import types
from brindle.errors import AuthorizationError, ExecutionError, PrimaryKeyConflict, ResourceLimitExceeded, StatementCanceled, StatementTimedOut, TransactionError, ValidationError, WriteWriteConflict
from brindle.governance import Cancellation, Limits
from brindle.session import Session
from brindle.store import Store

ALL = "CREATE TABLE v (k INTEGER NOT NULL, n BIGINT, f FLOAT, s TEXT, b BOOLEAN, ts TIMESTAMP, x BLOB, PRIMARY KEY (k))"
KV = "CREATE TABLE kv (k BIGINT NOT NULL, v TEXT, PRIMARY KEY (k))"


def rows(db, text):
    return db.sql(text).rows


def test_expressions(db):
    db.sql(ALL)
    db.sql("INSERT INTO v (k, n, f, s, b, ts) VALUES (1, 9223372036854775807, 1.5, 'a', TRUE, 7)")
    db.sql("INSERT INTO v (k) VALUES (2)")
    one = lambda e: db.frame(f"SELECT {e} FROM v WHERE k = 1").first()[0]
    assert one("n + 1") == (1 << 63) - 1
    assert one("0 - n - 2") == -(1 << 63)
    assert one("n * -2") == -(1 << 63)
    assert one("k + k") == 2
    assert one("k / 2") == 0.5
    assert one("-n") == -((1 << 63) - 1)
    assert one("f * 2") == 3.0
    assert one("ts = 7") is True
    assert one("n = f") is False
    assert one("s < 'b' AND NOT b = FALSE OR NULL") is True
    null = lambda e: db.frame(f"SELECT {e} FROM v WHERE k = 2").first()[0]
    assert [null(e) for e in ("n + 1", "f / 0", "s = 'a'", "b AND TRUE", "NOT b", "s = 1")] == [None] * 6
    for bad, said in (("n / 0", "cannot divide by zero"), ("s = 1", "type mismatch"), ("b < n", "type mismatch"), ("NOT n", "type mismatch")):
        with pytest.raises(ExecutionError, match=said):
            db.sql(f"SELECT {bad} FROM v")
    assert rows(db, "SELECT s, v.s, n FROM v WHERE b") == [("a", "a", (1 << 63) - 1)]
    assert db.frame("SELECT s, v.s, n + 1 FROM v").columns == ["s", "v.s", "expr_2"]


def test_order_of_nulls_and_hidden_columns(db):
    db.sql(ALL)
    for k, n in ((1, "3"), (2, "NULL"), (3, "1")):
        db.sql(f"INSERT INTO v (k, n) VALUES ({k}, {n})")
    assert rows(db, "SELECT k FROM v ORDER BY n") == [(3,), (1,), (2,)]
    assert rows(db, "SELECT k FROM v ORDER BY n DESC") == [(2,), (1,), (3,)]
    assert rows(db, "SELECT * FROM v ORDER BY n LIMIT 0") == []


def test_scan_order_is_that_of_key_bytes(db):
    db.sql("CREATE TABLE t (k TEXT NOT NULL, PRIMARY KEY (k)); CREATE TABLE i (k BIGINT NOT NULL, PRIMARY KEY (k))")
    for k in ("b", "aa", "a"):
        db.sql(f"INSERT INTO t (k) VALUES ('{k}')")
    for k in (1, -1, 0, -2):
        db.sql(f"INSERT INTO i (k) VALUES ({k})")
    assert rows(db, "SELECT k FROM t LIMIT 3") == [("a",), ("b",), ("aa",)]
    assert rows(db, "SELECT k FROM i LIMIT 4") == [(0,), (1,), (-2,), (-1,)]


def test_key_lookup_checks_its_literal(db):
    db.sql(ALL)
    db.sql("INSERT INTO v (k) VALUES (1)")
    assert rows(db, "SELECT k FROM v WHERE k = 1.0") == [(1,)]
    for bad in ("1.5", "'x'", "NULL", "2147483648"):
        with pytest.raises(ExecutionError):
            db.sql(f"SELECT k FROM v WHERE k = {bad}")


def test_insert_rules(db):
    db.sql("CREATE TABLE t (k BIGINT NOT NULL, d TEXT NOT NULL DEFAULT 'x', n INTEGER, PRIMARY KEY (k))")
    db.sql("INSERT INTO t (k) VALUES (1 + 1)")
    assert rows(db, "SELECT * FROM t") == [(2, "x", None)]
    with pytest.raises(PrimaryKeyConflict, match="primary key conflict on table 't'"):
        db.sql("INSERT INTO t (k) VALUES (2)")
    with pytest.raises(ExecutionError, match="missing primary key value for column 'k'"):
        db.sql("INSERT INTO t (d) VALUES ('y')")
    with pytest.raises(ExecutionError, match="type mismatch for column 'n'"):
        db.sql("INSERT INTO t (k, n) VALUES (3, 2147483648)")
    with pytest.raises(ExecutionError, match="not found"):
        db.sql("INSERT INTO t (k) VALUES (k)")
    with pytest.raises(ExecutionError, match="cannot divide by zero"):
        db.sql("INSERT INTO t (k, n) VALUES (4, 1); UPDATE t SET n = 1 WHERE k / 0 > 1.0")
    assert not db.in_transaction


def test_updates_see_the_old_row_and_count_matches(db):
    db.sql("CREATE TABLE t (k BIGINT NOT NULL, a BIGINT, b BIGINT, PRIMARY KEY (k)); INSERT INTO t (k, a, b) VALUES (1, 10, 20); INSERT INTO t (k, a, b) VALUES (2, 30, 40)")
    assert db.sql("UPDATE t SET a = b, b = a").count == 2
    assert sorted(rows(db, "SELECT a, b FROM t")) == [(20, 10), (40, 30)]
    assert db.sql("UPDATE t SET a = a WHERE k > 5").count == 0
    assert db.sql("DELETE FROM t WHERE a = 20").count == 1
    assert rows(db, "SELECT k FROM t") == [(2,)]


def test_key_updates_depend_on_scan_order(db):
    db.sql(KV + "; INSERT INTO kv (k, v) VALUES (1, 'a'); INSERT INTO kv (k, v) VALUES (2, 'b')")
    with pytest.raises(PrimaryKeyConflict):
        db.sql("UPDATE kv SET k = k + 1")
    assert db.sql("UPDATE kv SET k = k - 1").count == 2
    assert sorted(rows(db, "SELECT k, v FROM kv")) == [(0, "a"), (1, "b")]
    with pytest.raises(PrimaryKeyConflict):
        db.sql("UPDATE kv SET k = 7")
    with pytest.raises(PrimaryKeyConflict):
        db.sql("UPDATE kv SET k = 1 WHERE k = 0")


def test_snapshots_conflicts_and_time_travel(spark, store, db):
    db.sql(KV + "; INSERT INTO kv (k, v) VALUES (1, 'old')")
    before = store.state.ts
    other = Session(spark, store)
    db.sql("BEGIN")
    other.sql("UPDATE kv SET v = 'new' WHERE k = 1")
    assert rows(db, "SELECT v FROM kv") == [("old",)]
    db.sql("UPDATE kv SET v = 'mine'")
    assert rows(db, "SELECT v FROM kv") == [("mine",)]
    with pytest.raises(WriteWriteConflict, match="read_ts=2, conflicting_commit_ts=3"):
        db.sql("COMMIT")
    assert not db.in_transaction
    assert rows(db, "SELECT v FROM kv") == [("new",)]
    assert [tuple(r) for r in db.as_of("kv", before).collect()] == [(1, "old")]
    assert store.history(store.catalog.get_table("kv")).count() == 2
    assert store.metrics["write_conflicts"] == 1 and store.active == 0


def test_commits_without_a_common_key_both_hold(spark, store, db):
    db.sql(KV)
    other = Session(spark, store)
    db.sql("BEGIN; INSERT INTO kv (k, v) VALUES (1, 'a')")
    other.sql("INSERT INTO kv (k, v) VALUES (2, 'b')")
    db.sql("COMMIT")
    assert sorted(rows(other, "SELECT k FROM kv")) == [(1,), (2,)]


def test_transaction_protocol(db):
    for s in ("COMMIT", "ROLLBACK"):
        with pytest.raises(TransactionError, match="no active transaction"):
            db.sql(s)
    db.sql(KV + "; BEGIN")
    with pytest.raises(TransactionError, match="already active"):
        db.sql("BEGIN")
    with pytest.raises(ValidationError):
        db.sql("SELECT nothing FROM kv")
    assert db.in_transaction
    db.sql("INSERT INTO kv (k) VALUES (1); DELETE FROM kv; INSERT INTO kv (k) VALUES (1); ROLLBACK")
    assert rows(db, "SELECT k FROM kv") == []


def test_reopened_store_and_dropped_rows(spark, store, db):
    db.sql(KV + "; INSERT INTO kv (k, v) VALUES (1, 'a'); BEGIN; INSERT INTO kv (k, v) VALUES (2, 'b')")
    again = Session(spark, Store(spark, store.root))
    assert rows(again, "SELECT k FROM kv") == [(1,)]
    again.sql("DROP TABLE kv; " + KV)
    assert rows(again, "SELECT k FROM kv") == []


def test_compaction_and_vacuum(store, db):
    db.sql(KV)
    kv = store.catalog.get_table("kv")
    for i in range(3):
        db.sql(f"INSERT INTO kv (k, v) VALUES ({i}, 'a')")
    db.sql("UPDATE kv SET v = 'b' WHERE k = 1; DELETE FROM kv WHERE k = 2")
    pinned = store.pin()
    assert store.compact(kv) is False
    assert store.compact(kv, force=True) is True
    assert sorted(rows(db, "SELECT * FROM kv")) == [(0, "a"), (1, "b")]
    assert store.snapshot(kv, pinned - 1).count() == 3
    store.unpin(pinned)
    assert store.vacuum(kv) > 0
    db.sql("INSERT INTO kv (k, v) VALUES (2, 'c')")
    assert sorted(rows(db, "SELECT * FROM kv")) == [(0, "a"), (1, "b"), (2, "c")]


def test_bulk_load_checks_keys(spark, store, db):
    db.sql(KV)
    kv = store.catalog.get_table("kv")
    with pytest.raises(PrimaryKeyConflict):
        store.load(kv, spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string"))
    store.load(kv, spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    assert db.sql("UPDATE kv SET v = 'c' WHERE k = 2").count == 1
    assert sorted(rows(db, "SELECT * FROM kv")) == [(1, "a"), (2, "c")]


def test_limits(spark, store, db):
    db.sql(KV)
    for i in range(4):
        db.sql(f"INSERT INTO kv (k, v) VALUES ({i}, 'abc')")
    for limits, text, said in (
        (Limits(scan_rows=3), "SELECT k FROM kv LIMIT 1", "scan rows: actual=4, limit=3"),
        (Limits(sort_rows=3), "SELECT k FROM kv ORDER BY k", "sort rows"),
        (Limits(result_rows=3), "SELECT k FROM kv", "query result rows"),
        (Limits(result_bytes=43), "SELECT * FROM kv", "query result bytes: actual=44, limit=43"),
        (Limits(statements=1), "BEGIN; ROLLBACK", "statements"),
    ):
        with pytest.raises(ResourceLimitExceeded, match=said):
            Session(spark, store, limits).sql(text)
    assert len(rows(Session(spark, store, Limits(scan_rows=3)), "SELECT k FROM kv WHERE k = 1")) == 1


def test_roles(spark, store, db):
    db.sql(KV)
    reader, writer = Session(spark, store, role="reader"), Session(spark, store, role="writer")
    with pytest.raises(AuthorizationError):
        reader.sql("SELECT k FROM kv; DELETE FROM kv")
    writer.sql("INSERT INTO kv (k) VALUES (1)")
    with pytest.raises(AuthorizationError):
        writer.sql("DROP TABLE kv")
    assert rows(reader, "BEGIN; SELECT k FROM kv") == [(1,)]


def slow(spark):
    from pyspark.sql import functions as F

    session = Session(spark)
    df = spark.range(0, 200_000_000, 1, 4).select("id", F.sha2(F.repeat(F.col("id").cast("string"), 50), 512).alias("h"))
    session.attach("big", df, ["id"])
    return session


def test_timeout_and_cancellation(spark):
    session = slow(spark)
    text = "SELECT h FROM big ORDER BY h LIMIT 1"
    began = time.time()
    with pytest.raises(StatementTimedOut, match="statement timed out after 1500 ms"):
        session.sql(text, timeout_ms=1500)
    cancellation = Cancellation()
    timer = threading.Timer(1.5, cancellation.cancel)
    timer.start()
    with pytest.raises(StatementCanceled, match="user requested cancellation"):
        session.sql(text, cancellation=cancellation)
    assert time.time() - began < 60


def test_explain_runs_nothing(db):
    db.sql(KV)
    text = db.explain("SELECT k FROM kv WHERE k = 1; DELETE FROM kv; SELECT v FROM kv ORDER BY k LIMIT 1")
    assert "PrimaryKeyScan table=kv key=[k = 1]" in text and "Delete table=kv" in text and "SeqScan" in text
    assert db.sql("INSERT INTO kv (k) VALUES (1)").count == 1
    assert "Scan parquet" in db.explain("SELECT k FROM kv", catalyst=True) or "FileScan" in db.explain("SELECT k FROM kv", catalyst=True)


def test_rendering():
    assert [types.render(v) for v in (None, True, 3.0, 1.5, 1e21, b"\x0a", "NULL", -2)] == ["NULL", "true", "3", "1.5", "1000000000000000000000", "0a", "NULL", "-2"]
