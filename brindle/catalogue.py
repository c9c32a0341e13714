"""The engine's queries over the test tables, and DuckDB SQL that checks each.

Key ``user_id`` and timestamp ``event_id`` make ``events`` a log of versions, in
which ``error`` events play the tombstones.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import types
from .catalog import Column, Table
from .errors import WriteWriteConflict
from .operators import compaction, relational, versions
from .session import Session
from .sources.keyvalue import KeyValueLog
from .store import Store

KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],  # not unique: for scans only
    "events": ["event_id"],
    "conversations": ["conv_id", "turn"],
}
FLAGSHIP = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reader(spark: SparkSession, sf_dir: str, *names: str) -> Session:
    """A session that reads these tables."""
    session = Session(spark)
    for n in names:
        session.attach(n, table(spark, sf_dir, n), KEYS[n])
    return session


def select(text: str, name: str) -> Query:
    return lambda spark, sf_dir: reader(spark, sf_dir, name).frame(text)


def _folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='brindle-')}"
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex[:12]}"


def stored(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> Session:
    """A session on a new store that holds these columns of a table."""
    rows = table(spark, sf_dir, name).select(*columns)
    made = Table(name, tuple(Column(f.name, types.logical(f.dataType), f.name not in KEYS[name]) for f in rows.schema), tuple(KEYS[name]))
    store = Store(spark, _folder(spark))
    store.create_table(made)
    store.load(made, rows)
    return Session(spark, store)


def _after(name: str, columns: list[str], *statements: str, then: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = stored(spark, sf_dir, name, columns)
        for s in statements:
            session.sql(s)
        return session.frame(then)

    return run


def _joined(left: str, right: str, predicate: str, columns: list[str], names: tuple[str, str] | None = None, renamed: dict[str, str] | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = names or (left, right)
        out = relational.join(table(spark, sf_dir, left), table(spark, sf_dir, right), predicate, a, b)
        return out.select(*[F.col(f"`{c}`").alias((renamed or {}).get(c, c)) for c in columns])

    return run


def _log(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", *columns)


def _space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.live_bytes(_log(spark, sf_dir, "props"), ["user_id"], "event_id", "props").select("space_amplification")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    a = part.select(F.col("p_partkey").alias("l"), (F.col("p_partkey") + F.col("p_size")).alias("l_end"))
    b = part.select(F.col("p_partkey").alias("r"), F.col("p_partkey").alias("r_end"))
    return relational.overlapping(a, b, ("l", "l_end"), ("r", "r_end"), 64).where("l < r").select("l", "r")


def _own_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = stored(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    session.sql("BEGIN; INSERT INTO region (r_regionkey, r_name) VALUES (77, 'SOON GONE'); DELETE FROM region WHERE r_regionkey = 0 OR r_regionkey = 77")
    return session.frame("SELECT r_regionkey FROM region")


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return versions.conflicts(log, log.where("event_id <= 100"), ["user_id"], "event_id", 5000).select("user_id")


def _renamed(text: str, name: str, **columns: str) -> Query:
    """A dotted output name as one that any reader can quote."""
    return lambda spark, sf_dir: reader(spark, sf_dir, name).frame(text).toDF(*columns.values())


def _first_committer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two transactions that change a row, the second to commit fails."""
    first = stored(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    second = Session(spark, first.store)
    for session, word in ((first, "FIRST"), (second, "SECOND")):
        session.sql(f"BEGIN; UPDATE nation SET n_name = '{word}' WHERE n_nationkey = 3")
    first.sql("COMMIT")
    try:
        second.sql("COMMIT")
    except WriteWriteConflict:
        return first.frame("SELECT n_nationkey, n_name FROM nation")
    raise AssertionError("the second commit must fail")


def _point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key as it was before it was changed."""
    session = stored(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    before = session.store.state.ts
    session.sql("UPDATE nation SET n_name = 'NOW'")
    return session.as_of("nation", before).where("n_nationkey = 7").select("n_nationkey", "n_name")


def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store opened anew on what another one wrote."""
    session = stored(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    session.sql("UPDATE customer SET c_acctbal = c_acctbal - 1.0")
    return Session(spark, Store(spark, session.store.root)).frame("SELECT c_custkey, c_acctbal FROM customer")


def _vacuumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = stored(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    session.sql("UPDATE customer SET c_acctbal = c_acctbal + 2.0")
    held = session.store.catalog.get_table("customer")
    session.store.compact(held, force=True)
    session.store.vacuum(held)
    return session.frame("SELECT c_custkey, c_acctbal FROM customer")


def _recreated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dropped table's name is free, and its rows are gone."""
    session = stored(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    kept = session.frame("SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 2").first()
    session.sql("DROP TABLE region")
    session.sql("CREATE TABLE region (r_regionkey INTEGER NOT NULL, r_name TEXT, PRIMARY KEY (r_regionkey))")
    session.sql(f"INSERT INTO region (r_regionkey, r_name) VALUES ({kept[0]}, '{kept[1]}')")
    return session.frame("SELECT r_regionkey, r_name FROM region")


def _nations(spark: SparkSession, sf_dir: str, flush: bool) -> KeyValueLog:
    """The log of all nations put by key, every fifth deleted; opened anew, from runs or from the write-ahead log."""
    log = KeyValueLog(spark, _folder(spark))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # 25 rows at any scale
    for r in rows:
        log.put(b"%04d" % r["n_nationkey"], r["n_name"].encode())
    if flush:
        log.force_flush()
    for r in rows:
        if r["n_nationkey"] % 5 == 0:
            log.delete(b"%04d" % r["n_nationkey"])
    log.force_flush() if flush else log.sync()
    return KeyValueLog(spark, log.root)


def _key_value(flush: bool) -> Query:
    return lambda spark, sf_dir: _nations(spark, sf_dir, flush).scan().select(F.col("user_key").cast("string").alias("user_key"), F.col("value").cast("string").alias("value"))


def _key_value_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _nations(spark, sf_dir, False)
    found = [(k, None if (v := log.get(b"%04d" % k)) is None else v.decode()) for k in range(25)]
    return spark.createDataFrame(found, "n_nationkey int, n_name string")


KEY_VALUE_SQL = "SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS user_key, n_name AS value FROM nation WHERE n_nationkey % 5 <> 0"
PRICE = "CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1.0 ELSE c_acctbal END"
#: Name: query, SQL for DuckDB.
CATALOGUE: dict[str, tuple[Query, str]] = {
    "flagship": (select(FLAGSHIP, "orders"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "seq_scan_wildcard": (select("SELECT * FROM nation", "nation"), "SELECT * FROM nation"),
    "pk_point_scan": (select("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7", "orders"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7"),
    "pk_composite_scan": (select("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn = 1", "conversations"), "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn = 1"),
    "pk_partial_fallback": (select("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3", "conversations"), "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3"),
    "filter_eq_text": (select("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'", "customer"), "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_ne": (select("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'", "orders"), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'"),
    "filter_lt": (select("SELECT p_partkey, p_size FROM part WHERE p_size < 10", "part"), "SELECT p_partkey, p_size FROM part WHERE p_size < 10"),
    "filter_le": (select("SELECT p_partkey, p_size FROM part WHERE p_size <= 10", "part"), "SELECT p_partkey, p_size FROM part WHERE p_size <= 10"),
    "filter_gt": (select("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000.0", "customer"), "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000.0"),
    "filter_ge": (select("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000.0", "customer"), "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000.0"),
    "filter_and": (select("SELECT p_partkey FROM part WHERE p_size > 10 AND p_retailprice < 1500.0", "part"), "SELECT p_partkey FROM part WHERE p_size > 10 AND p_retailprice < 1500.0"),
    "filter_or": (select("SELECT p_partkey FROM part WHERE p_size = 1 OR p_size = 50", "part"), "SELECT p_partkey FROM part WHERE p_size = 1 OR p_size = 50"),
    "filter_not": (select("SELECT p_partkey FROM part WHERE NOT (p_size > 10)", "part"), "SELECT p_partkey FROM part WHERE NOT (p_size > 10)"),
    "filter_null_3vl": (select("SELECT o_orderkey FROM orders WHERE (o_orderkey = NULL) OR o_orderkey <= 3", "orders"), "SELECT o_orderkey FROM orders WHERE (o_orderkey = NULL) OR o_orderkey <= 3"),
    "proj_add": (select("SELECT o_orderkey, o_orderkey + 1 FROM orders", "orders"), "SELECT o_orderkey, CAST(o_orderkey + 1 AS BIGINT) AS expr_1 FROM orders"),
    "proj_sub": (select("SELECT p_partkey, p_partkey - p_size FROM part", "part"), "SELECT p_partkey, CAST(p_partkey - p_size AS BIGINT) AS expr_1 FROM part"),
    "proj_mul": (select("SELECT l_orderkey, l_extendedprice * (1 - l_discount) FROM lineitem", "lineitem"), "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS expr_1 FROM lineitem"),
    "proj_div": (select("SELECT p_partkey, p_partkey / p_size FROM part WHERE p_size != 0", "part"), "SELECT p_partkey, p_partkey / p_size AS expr_1 FROM part WHERE p_size != 0"),
    "proj_negate": (select("SELECT c_custkey, -c_acctbal FROM customer", "customer"), "SELECT c_custkey, -c_acctbal AS expr_1 FROM customer"),
    "proj_boolean": (select("SELECT c_custkey, c_acctbal > 0.0 FROM customer", "customer"), "SELECT c_custkey, c_acctbal > 0.0 AS expr_1 FROM customer"),
    "proj_qualified": (_renamed("SELECT nation.n_name FROM nation", "nation", a="nation_n_name"), "SELECT nation.n_name AS nation_n_name FROM nation"),
    "proj_saturating": (select("SELECT o_orderkey, 9223372036854775807 + o_orderkey FROM orders", "orders"), "SELECT o_orderkey, CASE WHEN o_orderkey > 0 THEN 9223372036854775807 ELSE 9223372036854775807 + o_orderkey END AS expr_1 FROM orders"),
    "sort_multi_hidden": (select("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC", "orders"), "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST"),
    "limit_pk_order": (select("SELECT c_custkey FROM customer LIMIT 5", "customer"), "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5"),
    "topk": (select("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "orders"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 10"),
    "timestamp_bigint": (select("SELECT event_id, ts FROM events WHERE ts < 1704499200000000", "events"), "SELECT event_id, epoch_us(ts) AS ts FROM events WHERE epoch_us(ts) < 1704499200000000"),
    "join_equi": (_joined("nation", "region", "n_regionkey = r_regionkey", ["n_nationkey", "n_name", "r_name"]), "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_theta": (_joined("supplier", "nation", "s_nationkey < n_nationkey AND s_acctbal > 5000.0", ["s_suppkey", "n_nationkey"]), "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > 5000.0"),
    "join_self_collision": (_joined("nation", "nation", "a.n_regionkey = b.n_regionkey", ["n_nationkey", "b.n_nationkey"], ("a", "b"), {"b.n_nationkey": "b_n_nationkey"}), "SELECT a.n_nationkey, b.n_nationkey AS b_n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"),
    "join_cross": (_joined("region", "nation", "TRUE", ["r_regionkey", "n_nationkey"]), "SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation"),
    "dml_insert_after": (_after("region", ["r_regionkey", "r_name"], "INSERT INTO region (r_regionkey, r_name) VALUES (99, 'NEW')", then="SELECT r_regionkey, r_name FROM region"), "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NEW'"),
    "dml_update_after": (_after("customer", ["c_custkey", "c_acctbal", "c_mktsegment"], "UPDATE customer SET c_acctbal = c_acctbal + 1.0 WHERE c_mktsegment = 'BUILDING'", then="SELECT c_custkey, c_acctbal FROM customer"), f"SELECT c_custkey, {PRICE} AS c_acctbal FROM customer"),
    "dml_update_key": (_after("nation", ["n_nationkey", "n_name"], "UPDATE nation SET n_nationkey = n_nationkey - 1", then="SELECT n_nationkey, n_name FROM nation"), "SELECT n_nationkey - 1 AS n_nationkey, n_name FROM nation"),
    "dml_delete_after": (_after("orders", ["o_orderkey", "o_orderstatus"], "DELETE FROM orders WHERE o_orderstatus = 'F'", then="SELECT o_orderkey FROM orders"), "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')"),
    "txn_own_writes": (_own_writes, "SELECT r_regionkey FROM region WHERE r_regionkey <> 0"),
    "txn_commit": (_after("customer", ["c_custkey", "c_acctbal", "c_mktsegment"], "BEGIN; UPDATE customer SET c_acctbal = c_acctbal + 1.0 WHERE c_mktsegment = 'BUILDING'; DELETE FROM customer WHERE c_custkey = 1; COMMIT", then="SELECT c_custkey, c_acctbal FROM customer"), f"SELECT c_custkey, {PRICE} AS c_acctbal FROM customer WHERE c_custkey <> 1"),
    "txn_rollback": (_after("region", ["r_regionkey", "r_name"], "BEGIN; DELETE FROM region; ROLLBACK", then="SELECT r_regionkey, r_name FROM region"), "SELECT r_regionkey, r_name FROM region"),
    "txn_first_committer": (_first_committer, "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'FIRST' ELSE n_name END AS n_name FROM nation"),
    "mvcc_point_read": (_point_read, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7"),
    "store_recovery": (_recovered, "SELECT c_custkey, c_acctbal - 1.0 AS c_acctbal FROM customer"),
    "store_vacuum": (_vacuumed, "SELECT c_custkey, c_acctbal + 2.0 AS c_acctbal FROM customer"),
    "ddl_drop_recreate": (_recreated, "SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 2"),
    "dml_insert_constant": (_after("region", ["r_regionkey", "r_name"], "INSERT INTO region (r_regionkey, r_name) VALUES (-(3 + 4) * 2, 'NEW')", then="SELECT r_regionkey, r_name FROM region"), "SELECT r_regionkey, r_name FROM region UNION ALL SELECT -14, 'NEW'"),
    "kv_range_scan": (_key_value(flush=True), KEY_VALUE_SQL),
    "kv_wal_replay": (_key_value(flush=False), KEY_VALUE_SQL),
    "kv_point_get": (_key_value_get, "SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS n_name FROM nation"),
    "mvcc_as_of": (lambda s, d: versions.as_of(_log(s, d, "value"), ["user_id"], "event_id", 5000).select("user_id", "value"), "SELECT user_id, max_by(value, event_id) AS value FROM events WHERE event_id <= 5000 GROUP BY user_id"),
    "mvcc_conflict_keys": (_conflicts, "SELECT DISTINCT user_id FROM events WHERE event_id > 5000 AND user_id IN (SELECT user_id FROM events WHERE event_id <= 100)"),
    "mvcc_history": (lambda s, d: versions.history(_log(s, d), ["user_id"], "event_id").select("user_id", "versions"), "SELECT user_id, count(*) AS versions FROM events GROUP BY user_id"),
    "gc_prune": (lambda s, d: versions.pruned(_log(s, d), ["user_id"], "event_id", 5000).select("user_id", "event_id"), "SELECT user_id, event_id FROM events WHERE event_id > 5000 UNION ALL SELECT user_id, max(event_id) FROM events WHERE event_id <= 5000 GROUP BY user_id"),
    "compaction_latest": (lambda s, d: versions.compacted(_log(s, d, "event_type"), ["user_id"], ["event_id"]), "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id"),
    "compaction_tombstones": (lambda s, d: versions.compacted(_log(s, d, "event_type"), ["user_id"], ["event_id"]).where("event_type = 'error'").select("user_id", "event_id"), "SELECT user_id, event_id FROM (SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS t FROM events GROUP BY user_id) WHERE t = 'error'"),
    "tier_buckets": (lambda s, d: table(s, d, "documents").groupBy(compaction.tier_of(F.col("n_chars")).alias("tier")).agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(floor(log2(greatest(n_chars, 1))) AS INTEGER) AS tier, count(*) AS n FROM documents GROUP BY 1"),
    "range_overlap": (_ranges, "SELECT a.p_partkey AS l, b.p_partkey AS r FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_partkey + a.p_size >= b.p_partkey"),
    "space_amplification": (_space, "SELECT (SELECT sum(strlen(props)) FROM (SELECT max_by(props, event_id) AS props FROM events GROUP BY user_id)) / (SELECT sum(strlen(props)) FROM events) AS space_amplification"),
}
QUERIES: dict[str, Query] = {name: query for name, (query, _) in CATALOGUE.items()}
ORACLE: dict[str, str] = {name: sql for name, (_, sql) in CATALOGUE.items()}
