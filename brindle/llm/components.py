"""Connected components by alternating large-star and small-star steps.

Each step joins every node's neighbours to the least of them; the edges become
stars whose centre is the least node of its component. Nothing is collected;
each round is written to the shared folder, so lost executors cost one round.
A centre with many neighbours is broadcast, so its edges stay where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, removed, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` of each node of ``edges`` (columns ``u``, ``v``, of one comparable type).

    ``root`` is the least node of the component. Loops and repeated edges don't
    matter; nodes only in loops and null nodes are left out; no edges give no rows.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    state = _state(e)
    for _ in range(max_rounds if state[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.sum(F.when(F.col("v") > F.col("u"), 1).otherwise(0)).alias("n"))
        least = written(least, "least")
        large = hot_join(both.where("v > u"), least, "u", state[0])
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        next_least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = hot_join(large, next_least, "u", state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, written(small.unionByName(next_least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        removed(last, least, large, next_least)
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
