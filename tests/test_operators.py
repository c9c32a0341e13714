"""Joins, version logs, compaction pickers, and the catalogue against DuckDB."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.catalogue import CATALOGUE
from brindle.errors import ExecutionError, ResourceLimitExceeded
from brindle.governance import Limits
from brindle.operators import compaction as C
from brindle.operators import relational, versions

SF = "/root/testdata/sf0.001"


def test_join_names_and_nulls(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, name string")
    profiles = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "id long, city string")
    out = relational.join(users, profiles, "users.id = profiles.id", "users", "profiles")
    assert out.columns == ["id", "name", "profiles.id", "city"]
    assert [tuple(r) for r in out.collect()] == [(1, "a", 1, "x")]
    theta = relational.join(users, profiles, "id < profiles.id AND city != 'q'", "users", "profiles")
    assert sorted(tuple(r)[0] for r in theta.collect()) == [1, 2]
    assert relational.join(users, profiles, "TRUE", "users", "profiles").count() == 9
    with pytest.raises(ExecutionError):
        relational.join(users, profiles, "nothing = 1")
    for most in (2, 8):
        with pytest.raises(ResourceLimitExceeded, match="join rows"):
            relational.join(users, profiles, "id = profiles.id", "users", "profiles", Limits(join_rows=most))
    assert relational.join(users, profiles, "id = profiles.id", "users", "profiles", Limits(join_rows=9)).count() == 1


def test_overlapping_against_brute_force(spark):
    rnd = random.Random(1)
    a = [(i, x := rnd.randrange(-50, 200), x + rnd.randrange(-2, 40)) for i in range(60)]
    b = [(i, x := rnd.randrange(-50, 200), x + rnd.randrange(-2, 40)) for i in range(60)]
    got = relational.overlapping(spark.createDataFrame(a, "i long, a long, b long"), spark.createDataFrame(b, "j long, c long, d long"), ("a", "b"), ("c", "d"), 16).select("i", "j").collect()
    want = {(i, j) for i, p, q in a for j, r, s in b if p <= q and r <= s and p <= s and r <= q}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_version_logs(spark):
    log = spark.createDataFrame([("a", 1, "x", False), ("a", 3, "y", False), ("b", 2, "z", False), ("b", 4, None, True), ("c", 5, "w", False)], "k string, ts long, v string, dead boolean")
    pairs = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert pairs(versions.as_of(log, ["k"], "ts", 4, F.col("dead")), "k", "v") == [("a", "y")]
    assert pairs(versions.as_of(log, ["k"], "ts", 2), "k", "v") == [("a", "x"), ("b", "z")]
    assert pairs(versions.pruned(log, ["k"], "ts", 3), "k", "ts") == [("a", 3), ("b", 2), ("b", 4), ("c", 5)]
    assert pairs(versions.history(log, ["k"], "ts"), "k", "versions", "latest_commit_ts") == [("a", 2, 3), ("b", 2, 4), ("c", 1, 5)]
    assert pairs(versions.conflicts(log, log.where("ts = 1"), ["k"], "ts", 2), "k", "conflicting_commit_ts") == [("a", 3)]
    assert pairs(versions.compacted(log, ["k"], ["ts"]), "k", "dead") == [("a", False), ("b", True), ("c", False)]
    assert pairs(versions.live_bytes(log, ["k"], "ts", "v", F.col("dead")), "live_bytes", "total_bytes") == [(2, 4)]


def file(i, level, a, b, size=10):
    return C.TableFile(i, level, a, b, size)


def test_leveled_picker():
    assert C.leveled([file(1, 1, b"a", b"z")], base_bytes=100) is None
    task = C.leveled([file(1, 0, b"a", b"c"), file(2, 1, b"b", b"d"), file(3, 1, b"e", b"f")])
    assert task.level == 1 and task.inputs == (1, 2)
    deep = C.leveled([file(4, 1, b"a", b"c", 80), file(5, 1, b"d", b"f", 80), file(6, 2, b"a", b"b", 50)], base_bytes=100)
    assert deep.level == 2 and deep.inputs == (5,) and deep.score == 1.6
    # One file of level 0 moves: by the number of files that it meets, not their bytes, then by id.
    top = [file(1, 0, b"a", b"z"), file(2, 0, b"a", b"c"), file(3, 0, b"x", b"z")]
    below = [file(7, 1, b"a", b"b", 1000), file(8, 1, b"x", b"x", 1), file(9, 1, b"y", b"z", 1)]
    few = C.leveled([*top, *below])
    assert few.inputs == (2, 7) and few.score == 3 / 4 + 1 + 0.01
    # A full level 0 goes before a level at seven times its target.
    full = C.leveled([*top, file(4, 0, b"m", b"n"), file(5, 1, b"a", b"b", 700)], base_bytes=100)
    assert full.inputs == (3,) and full.score == 11 and C.leveled([]) is None


def test_tiered_picker_and_scheduler():
    assert C.tiered([file(i, 0, b"a", b"b", 10 + i) for i in range(3)]) is None
    task = C.tiered([file(i, 0, b"a", b"b", 8 + i) for i in range(4)])
    assert task.inputs == (0, 1, 2, 3)
    s = C.Scheduler()
    low, high = C.Task(1, (1,), 1.0), C.Task(1, (2,), 2.0)
    assert s.submit(low) and s.submit(high) and not s.submit(low)
    assert s.next() == high and s.next() == low and s.next() is None
    assert not s.submit(low)
    s.done(low)
    assert s.submit(low) and len(s) == 1
    assert C.Amplification(user_bytes=10, compaction_bytes=30, lookups=2, files_checked=6, live_bytes=5, total_bytes=20).write == 3.0


@pytest.mark.parametrize("query", CATALOGUE)
def test_catalogue(spark, query):
    run, sql = CATALOGUE[query]
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(sql)
    got = run(spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    assert mine == sorted(repr(r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_range_overlap_over_the_whole_table(spark):
    from brindle import catalogue

    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey", "p_size").collect()
    want = sorted((a["p_partkey"], b["p_partkey"]) for a in part for b in part if a["p_partkey"] < b["p_partkey"] <= a["p_partkey"] + a["p_size"])
    got = sorted(tuple(r) for r in catalogue.QUERIES["range_overlap"](spark, "/root/testdata/sf0.01").collect())
    assert got == want and max(got)[0] > 200


def test_tiers_of_columns_and_sizes_agree(spark):
    from brindle.operators import compaction

    sizes = [None, -5, 0, 1, 2, 3, 4, 7, 8, 1023, 1024, (1 << 53) + 1, (1 << 62) - 1, 1 << 62]
    got = spark.createDataFrame([(x,) for x in sizes], "size long").select(compaction.tier_of(F.col("size")).alias("t"))
    assert [r["t"] for r in got.collect()] == [None if x is None else compaction.tier(x) for x in sizes]


def test_join_nodes_are_lowered(spark):
    from brindle import types
    from brindle.catalog import Column, Table
    from brindle.plans import logical, lowering
    from brindle.sql import ast, parse_expression

    a = Table("a", (Column("k", types.BIGINT, False), Column("v", types.BIGINT)), ("k",))
    b = Table("b", a.columns, a.primary_key)
    held = {"a": spark.createDataFrame([(1, 10), (2, 20), (3, None)], "k long, v long"), "b": spark.createDataFrame([(1, 7), (3, 8), (4, 9)], "k long, v long")}
    plan = logical.Filter(logical.Join(logical.Scan(a), logical.Filter(logical.Scan(b), parse_expression("v < 9")), parse_expression("a.k = b.k")), parse_expression("k > 0"))
    plan = logical.Limit(logical.Sort(plan, (ast.OrderItem(parse_expression("k"), descending=True),)), 1)
    seen = []
    out = lowering.data_frame(logical.physical(plan), lambda t: held[t.name], lambda what, df: seen.append(what) or df)
    assert out.columns == ["k", "v", "b.k", "b.v"] and [tuple(r) for r in out.collect()] == [(3, None, 3, 8)]
    assert seen.count("join rows") == 2 and seen.count("scan rows") == 2
    itself = lowering.data_frame(logical.Join(logical.Scan(a), logical.Scan(a), parse_expression("a.k < right.k")), lambda t: held[t.name])
    assert itself.columns == ["k", "v", "right.k", "right.v"] and itself.count() == 3
