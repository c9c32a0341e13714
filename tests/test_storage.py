"""The key-value log, background maintenance, settings, functions."""

import json
import logging
import time
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brindle import admin, config, observability
from brindle import functions as bf
from brindle.errors import EngineError, StatementTimedOut
from brindle.sources.keyvalue import SCHEMA, DamagedRun, KeyValueLog, decode_records, encode_record
from brindle.streaming.workers import MaintenanceWorker


def test_put_get_delete_flush_reopen(spark, tmp_path):
    root = f"file://{tmp_path}/kv"
    kv = KeyValueLog(spark, root)
    for i in range(20):
        kv.put(b"k%04d" % i, b"v%d" % i)
    kv.force_flush()
    kv.put(b"k0001", b"new")
    kv.delete(b"k0002")
    assert (kv.get(b"k0000"), kv.get(b"k0001"), kv.get(b"k0002"), kv.get(b"nothing")) == (b"v0", b"new", None, None)
    kv.sync()
    kv.put(b"k0003", b"not synced")
    again = KeyValueLog(spark, root)
    assert again.metrics["recovered"] == 2 and again.sequence == 22
    assert (again.get(b"k0001"), again.get(b"k0002"), again.get(b"k0003")) == (b"new", None, b"v3")
    assert sorted(bytes(r["user_key"]) for r in again.scan(b"k0001", b"k0004").collect()) == [b"k0001", b"k0003"]
    again.force_flush()
    assert KeyValueLog(spark, root).get(b"k0001") == b"new"


def test_damaged_tail_is_dropped_and_counted():
    lines = encode_record(1, "put", b"a", b"1") + encode_record(2, "delete", b"b", b"")
    assert decode_records(lines)[1] == 0
    assert [r[0] for r in decode_records(lines + "0000 half")[0]] == [1, 2]
    good, dropped = decode_records(lines.replace('"put"', '"PUT"'))
    assert good == [] and dropped == len(lines)


def test_runs_are_checked_when_opened(spark, tmp_path):
    root = f"file://{tmp_path}/kv"
    kv = KeyValueLog(spark, root)
    kv.put(b"a", b"1")
    kv.delete(b"b")
    kv.force_flush()
    run = next(iter(kv.runs.values()))
    assert KeyValueLog(spark, root).get(b"a") == b"1"
    changed = [(bytearray(b"a"), 1, False, bytearray(b"2")), (bytearray(b"b"), 2, True, None)]
    spark.createDataFrame(changed, SCHEMA).write.mode("overwrite").parquet(run.path)
    with pytest.raises(DamagedRun, match="checksum"):
        KeyValueLog(spark, root)
    assert KeyValueLog(spark, root, verify=False).get(b"a") == b"2"
    for f in (tmp_path / "kv" / "runs" / run.path.rsplit("/", 1)[-1]).glob("part-*"):
        f.write_bytes(b"not a run")
    with pytest.raises(DamagedRun, match="read"):
        KeyValueLog(spark, root)


def test_close_settings_and_segments(spark, tmp_path):
    settings = config.from_toml("[wal]\nsegment_bytes = 60\n[runs]\nbloom_fpr = 0.1\nverify = false")
    root = f"file://{tmp_path}/kv"
    with KeyValueLog.configured(spark, root, settings) as kv:
        for i in range(3):
            kv.put(b"k%d" % i, b"v" * i)
    kv.close()
    assert len(list((tmp_path / "kv" / "wal").glob("*.log"))) == 3
    with pytest.raises(EngineError, match="closed"):
        kv.put(b"k", b"v")
    again = KeyValueLog.configured(spark, root, settings)
    assert again.metrics["recovered"] == 3 and again.get(b"k2") == b"vv"
    with pytest.raises(StatementTimedOut):
        again.force_flush(timeout_ms=1)
    assert again.get(b"k2") == b"vv" and not again.runs
    again.close(flush=True)
    assert len(again.runs) == 1 and not list((tmp_path / "kv" / "wal").glob("*.log"))


@pytest.mark.parametrize(("strategy", "options"), [("leveled", {}), ("tiered", {"max_per_tier": 2})])
def test_merges_keep_the_newest(spark, tmp_path, strategy, options):
    kv = KeyValueLog(spark, f"file://{tmp_path}/kv", sync="never", strategy=strategy, **options)
    for i in range(4):
        kv.put(b"hot", b"hot-%d" % i)
        kv.put(b"cold-%d" % i, b"x")
        kv.force_flush()
    kv.delete(b"cold-0")
    kv.force_flush()
    before = kv.live_bytes()
    while kv.compact():
        pass
    assert kv.get(b"hot") == b"hot-3" and kv.get(b"cold-0") is None and kv.get(b"cold-1") == b"x"
    assert kv.live_bytes()[0] == before[0] and kv.live_bytes()[1] < before[1]
    assert kv.metrics["compactions"] >= 1 and kv.amplification.write > 0
    assert kv.entries().where("tombstone").count() == 1


def test_maintenance_worker(store, db):
    db.sql("CREATE TABLE t (k BIGINT NOT NULL, PRIMARY KEY (k))")
    table = store.catalog.get_table("t")
    for i in range(3):
        db.sql(f"INSERT INTO t (k) VALUES ({i})")
    store.compact(table, force=True)
    with MaintenanceWorker(store, 0.2) as worker:
        end = time.time() + 30
        while not worker.last_removed and time.time() < end and len(store.state.files[store.state.ids["t"]]) > 1:
            time.sleep(0.1)
    assert len(store.state.files[store.state.ids["t"]]) == 1
    assert sorted(r[0] for r in db.sql("SELECT k FROM t").rows) == [0, 1, 2]


def test_config():
    c = config.from_toml('[compaction]\nstrategy = "tiered"\n[compaction.tiered]\nmax_per_tier = 8\n[server]\ntimeout_ms = 50')
    assert c.compaction.tiered.max_per_tier == 8 and c.server.limits().timeout_ms == 50 and c.storage.sync == "on_commit"
    for bad, said in (("[server]\nspeed = 1", "unknown setting server.speed"), ("[server]\nscan_rows = 0", "server.scan_rows must be > 0"), ('[storage]\nsync = "often"', "storage.sync"), ('[server]\nscan_rows = "x"', "wrong type"), ("x", "not TOML"), ("storage = 1", "must be a table")):
        with pytest.raises(config.ConfigError, match=said):
            config.from_toml(bad)
    tls = '[security.tls]\nmode = "required"\ncert = "c"\nkey = "k"'
    for bad, said in (
        ('[security]\nauth = "token"\n' + tls, "at least one"),
        ('[security]\nauth = "token"\ntokens = [{name = "a", token = "x"}]', "tls.mode"),
        ('[security]\nauth = "password"\nusers = [{name = "a", password = "x"}, {name = "a", password = "y"}]\n' + tls, "once"),
        ('[security]\nusers = [{name = "a", password = "x", role = "king"}]', "unknown role"),
        ('[security]\nusers = [{name = "a", pass = "x"}]', "unknown setting security.users.pass"),
        ("[security]\nusers = 1", "list of tables"),
        ('[security.tls]\nmode = "required"', "cert and key"),
        ("[runs]\nbloom_fpr = 1.0", "bloom_fpr"),
        ("[runs]\nverify = 1", "wrong type"),
        ("[wal]\nsegment_bytes = 0", "must be > 0"),
    ):
        with pytest.raises(config.ConfigError, match=said):
            config.from_toml(bad)


def test_admin_check_and_bundle(tmp_path, capsys):
    path, root, logs = tmp_path / "c.toml", tmp_path / "data", tmp_path / "logs"
    path.write_text('[server]\nscan_rows = 7\n[security]\nusers = [{name = "ann", password = "hush", role = "admin"}]')
    (root / "runs").mkdir(parents=True)
    (root / "runs" / "a").write_bytes(b"12345")
    logs.mkdir()
    (logs / "old.log").write_text("x" * 50 + "\nlogin password=hush ok\n")
    assert admin.main(["config", "check", "--config", str(path)]) == 0
    out = capsys.readouterr().out
    assert "server.scan_rows = 7" in out and "security.users.0.name = ann" in out and "hush" not in out
    assert admin.main(["config", "check", "--config", str(tmp_path / "none")]) == 2
    with pytest.raises(SystemExit) as e:
        admin.main(["config", "chek"])
    assert e.value.code == 64
    capsys.readouterr()
    assert admin.main(["diagnostics", "bundle", "--config", str(path), "--root", str(root), "--output", str(tmp_path / "out"), "--logs", str(logs), "--max-log-bytes", "40"]) == 0
    made = Path(capsys.readouterr().out.strip())
    manifest = json.loads((made / "manifest.json").read_text())
    assert manifest["storage"]["runs"] == {"files": 1, "bytes": 5} and manifest["logs"] == {"old.log": 40} and manifest["warnings"] == []
    text = "".join(p.read_text() for p in made.rglob("*") if p.is_file())
    assert "hush" not in text and "password=<hidden>" in text
    sums = dict(line.split("  ")[::-1] for line in (made / "checksums.crc32").read_text().splitlines())
    assert set(sums) == {"manifest.json", "logs/old.log"}
    assert all(zlib.crc32((made / n).read_bytes()) == int(c, 16) for n, c in sums.items())
    path.write_text("[server]\nspeed = 1")
    assert admin.main(["diagnostics", "bundle", "--config", str(path), "--root", str(tmp_path / "none"), "--output", str(tmp_path / "more")]) == 0
    warned = json.loads((Path(capsys.readouterr().out.strip()) / "manifest.json").read_text())["warnings"]
    assert len(warned) == 2 and "speed" in warned[0] and "none" in warned[1]


def test_log_levels_from_the_environment(capfd):
    assert observability.levels("warn, brindle.server=debug") == {"brindle": logging.WARNING, "brindle.server": logging.DEBUG}
    for bad in ("loud", "=info", "a=b=c"):
        with pytest.raises(config.ConfigError):
            observability.levels(bad)
    top = logging.getLogger("brindle")
    try:
        for _ in range(2):
            observability.init_logging({"BRINDLE_LOG": "error,brindle.x=info", "BRINDLE_LOG_TARGET": "0"})
        logging.getLogger("brindle.x").info("said once")
        logging.getLogger("brindle.y").info("not said")
        err = capfd.readouterr().err
        assert err.count("said once") == 1 and "not said" not in err and "brindle.x" not in err
    finally:
        top.handlers, top.propagate = [], True
        top.setLevel(logging.NOTSET)


def test_functions(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    df = spark.createDataFrame([(high, 1), (low, -1), (low, 2), (None, 1), (7, 2)], "a long, b long")
    got = df.select(bf.saturating_add(F.col("a"), F.col("b")), bf.saturating_subtract(F.col("b"), F.col("a")), bf.saturating_multiply(F.col("a"), F.col("b")), bf.negate(F.col("a")), bf.compare("<", F.col("a"), F.col("b")))
    want = [(high, 1 - high, high, -high, False), (low, high, high, high, True), (low + 2, high, low, high, True), (None,) * 5, (9, -5, 14, -7, False)]
    assert [tuple(r) for r in got.collect()] == want
    assert [r[0] for r in df.where("a = 7 OR a IS NULL").select(bf.divide(F.col("a"), F.col("b") - 1)).collect()] == [None, 7.0]
