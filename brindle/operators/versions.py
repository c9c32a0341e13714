"""Operators on a log of versions: rows with a key and a commit timestamp.

All aggregate with partial results in the tasks, so a key with a third of all
versions costs each task one row of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lowering import name
from ..store import latest


def as_of(log: DataFrame, keys: list[str], ts_col: str, ts: int, tombstone: Column | None = None) -> DataFrame:
    """The newest version of each key up to ``ts``; keys whose newest is a tombstone are gone."""
    out = latest(log.where(F.col(name(ts_col)) <= ts), keys, [ts_col])
    return out if tombstone is None else out.where(~F.coalesce(tombstone, F.lit(False)))


def conflicts(log: DataFrame, staged: DataFrame, keys: list[str], ts_col: str, read_ts: int) -> DataFrame:
    """Keys of ``staged`` that someone committed after ``read_ts``, with the newest such timestamp."""
    newer = log.where(F.col(name(ts_col)) > read_ts).groupBy(*[name(k) for k in keys]).agg(F.max(name(ts_col)).alias("conflicting_commit_ts"))
    return newer.join(staged.select(*[F.col(name(k)) for k in keys]), keys, "left_semi")


def history(log: DataFrame, keys: list[str], ts_col: str) -> DataFrame:
    """Number of versions and the latest commit of each key."""
    return log.groupBy(*[name(k) for k in keys]).agg(F.count(F.lit(1)).alias("versions"), F.max(name(ts_col)).alias("latest_commit_ts"))


def pruned(log: DataFrame, keys: list[str], ts_col: str, watermark: int) -> DataFrame:
    """What garbage collection keeps: all versions after the watermark, and each key's newest up to it."""
    return log.where(F.col(name(ts_col)) > watermark).unionByName(latest(log.where(F.col(name(ts_col)) <= watermark), keys, [ts_col]))


def compacted(log: DataFrame, keys: list[str], sequence_cols: list[str]) -> DataFrame:
    """The merge of sorted runs: each key's newest entry, tombstones included."""
    return latest(log, keys, sequence_cols)


def live_bytes(log: DataFrame, keys: list[str], ts_col: str, value_col: str, tombstone: Column | None = None) -> DataFrame:
    """Bytes of the newest values (a tombstone's are 0), of all versions, and their ratio."""
    size = F.coalesce(F.octet_length(F.col(name(value_col))), F.lit(0)).cast("long")
    alive = size if tombstone is None else F.when(F.coalesce(tombstone, F.lit(False)), 0).otherwise(size)
    each = log.withColumn("__live", alive).groupBy(*[name(k) for k in keys]).agg(F.max_by("__live", F.col(name(ts_col))).alias("live"), F.sum(size).alias("total"))
    both = each.agg(F.sum("live").alias("live_bytes"), F.sum("total").alias("total_bytes"))
    return both.select("live_bytes", "total_bytes", (F.col("live_bytes") / F.col("total_bytes")).alias("space_amplification"))
