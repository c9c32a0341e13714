"""The commit log: writers that die, writers that race, checkpoints, vacuumed versions."""

import os
import threading
import time

import pytest

from brindle import store as stores
from brindle.errors import EngineError, TransactionError
from brindle.governance import governed
from brindle.session import Session
from brindle.store import Store

TABLE = "CREATE TABLE t (k BIGINT NOT NULL, v TEXT, PRIMARY KEY (k))"


def path_of(store, ts):
    return f"{store.root.removeprefix('file://')}/_log/{ts:020d}.json"


def test_a_torn_commit_is_nobodys(spark, store):
    db = Session(spark, store)
    db.sql(TABLE)
    db.sql("INSERT INTO t (k, v) VALUES (1, 'a')")
    with open(path_of(store, store.state.ts + 1), "w") as f:
        f.write('{"ts": 3, "add": [')
    again = Session(spark, Store(spark, store.root))
    assert again.sql("SELECT k FROM t").rows == [(1,)]
    again.sql("INSERT INTO t (k, v) VALUES (2, 'b')")
    assert sorted(Session(spark, Store(spark, store.root)).sql("SELECT k FROM t").rows) == [(1,), (2,)]


def test_damage_before_good_commits_is_an_error(spark, store):
    db = Session(spark, store)
    for s in (TABLE, "INSERT INTO t (k, v) VALUES (1, 'a')", "INSERT INTO t (k, v) VALUES (2, 'a')"):
        db.sql(s)
    with open(path_of(store, 2), "r+") as f:
        f.write("x")
    with pytest.raises(TransactionError, match="damaged at 2"):
        Store(spark, store.root)


def test_commits_are_published_once(store):
    made = []
    threads = [threading.Thread(target=lambda i=i: made.append((store._publish(f"{store.root}/_log/{99:020d}.json", {"writer": i}), i))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    ((_, winner),) = [m for m in made if m[0]]
    assert store._read(f"{store.root}/_log/{99:020d}.json") == {"writer": winner}
    assert not [n for n in os.listdir(f"{store.root.removeprefix('file://')}/_log") if n.endswith(".tmp")]


def test_two_creators_and_two_loaders(spark, store):
    other = Store(spark, store.root)
    Session(spark, store).sql(TABLE)
    table = store.catalog.get_table("t")
    with pytest.raises(EngineError):
        other.create_table(table)
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    other.refresh()
    stage = other.stage

    def late(table, versions):
        # The other load comes between this one's first look and its commit.
        path = stage(table, versions)
        store.load(table, rows)
        return path

    other.stage = late
    with pytest.raises(TransactionError, match="not empty"):
        other.load(table, spark.createDataFrame([(2, "b")], "k long, v string"))
    assert Session(spark, Store(spark, store.root)).sql("SELECT k FROM t").rows == [(1,)]


def test_checkpoints_and_one_scan_of_deltas(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "CHECKPOINT_EVERY", 3)
    db = Session(spark, store)
    db.sql(TABLE)
    for k in range(6):
        db.sql(f"INSERT INTO t (k, v) VALUES ({k}, 'v{k}')")
    os.remove(path_of(store, 1))  # the checkpoint stands for it
    again = Store(spark, store.root)
    assert again.state == store.state
    table = again.catalog.get_table("t")
    assert again.history(table)._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert sorted(r["__commit_ts"] for r in again.history(table).collect()) == [2, 3, 4, 5, 6, 7]


def test_vacuumed_versions_are_an_error(spark, store):
    db = Session(spark, store)
    db.sql(TABLE)
    db.sql("INSERT INTO t (k, v) VALUES (1, 'a')")
    before = store.state.ts
    db.sql("UPDATE t SET v = 'b'")
    assert db.as_of("t", before).collect()[0]["v"] == "a"
    table = store.catalog.get_table("t")
    assert store.compact(table, force=True) and store.vacuum(table) == 2
    with pytest.raises(TransactionError, match="vacuumed"):
        db.as_of("t", before)
    with pytest.raises(TransactionError, match="vacuumed"):
        Session(spark, Store(spark, store.root)).as_of("t", before)
    assert db.sql("SELECT v FROM t").rows == [("b",)]


def test_compaction_goes_on_while_others_commit(spark, store, monkeypatch):
    db = Session(spark, store)
    db.sql(TABLE)
    db.sql("INSERT INTO t (k, v) VALUES (1, 'a')")
    real = store.stage

    def slow(table, versions):
        path = real(table, versions)
        monkeypatch.setattr(store, "stage", real)
        Session(spark, Store(spark, store.root)).sql("INSERT INTO t (k, v) VALUES (2, 'b')")
        return path

    monkeypatch.setattr(store, "stage", slow)
    assert store.compact(store.catalog.get_table("t"), force=True)
    assert sorted(db.sql("SELECT k FROM t").rows) == [(1,), (2,)]


def test_work_that_got_done_is_no_timeout(spark):
    assert governed(spark, lambda: time.sleep(0.3) or "done", 50, None) == "done"


def test_key_update_uses_no_window(spark, store):
    db = Session(spark, store)
    db.sql(TABLE)
    for k in (-2, -1, 0, 1, 5):
        db.sql(f"INSERT INTO t (k, v) VALUES ({k}, 'v{k}')")
    with pytest.raises(EngineError):
        db.sql("UPDATE t SET k = k + 1")
    db.sql("UPDATE t SET k = k + 10 WHERE k > 0")
    assert sorted(db.sql("SELECT k FROM t").rows) == [(-2,), (-1,), (0,), (11,), (15,)]
