"""Consistent placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: a
permutation given by an offset and a step, both hashed from its name. Shards
take turns; at its turn a shard claims the first slot of its order that is
still free. A key's slot is its hash modulo the size, so placement is one
lookup, shards get equal numbers of slots (in proportion to their weights), and
removing a shard moves few keys of the others.

The table has ``size`` rows whatever the data, so broadcasting it is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

TABLE_SIZE = 65_537
MAX_TABLE_SIZE = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(name: str, use: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, person=use).digest(), "big")


def lookup_table(shards: Sequence[str] | Mapping[str, float], size: int = TABLE_SIZE) -> np.ndarray:
    """Shard index of each slot.

    ``shards``: distinct names, or names with positive weights. In each round a
    shard claims as many slots as its weight relative to the largest allows,
    carrying the fraction. The result depends on the set of names only, not on
    their order: turns go by name.
    """
    names = list(shards)
    weights = dict(shards) if isinstance(shards, Mapping) else dict.fromkeys(names, 1.0)
    if not names or len(weights) != len(names):
        raise ValueError("shards must be distinct and at least one")
    if not all(w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    if not _is_prime(size) or not len(names) <= size <= MAX_TABLE_SIZE:
        raise ValueError(f"size must be a prime from the number of shards to {MAX_TABLE_SIZE}")
    turns = sorted(range(len(names)), key=lambda i: names[i])
    at = [_hash(n, b"offset") % size for n in names]
    step = [_hash(n, b"step") % (size - 1) + 1 if size > 2 else 1 for n in names]
    most = max(weights.values())
    credit = [0.0] * len(names)
    table, left = [-1] * size, size
    while left:
        for i in turns:
            credit[i] += weights[names[i]] / most
            while credit[i] >= 1 - 1e-9 and left:
                while table[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % size
                table[at[i]] = i
                credit[i] -= 1
                left -= 1
    return np.array(table, dtype=np.int32)


def assign(df: DataFrame, keys: Sequence[str], shards: Sequence[str] | Mapping[str, float], size: int = TABLE_SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard name of each row.

    The slot is xxhash64 of the key columns modulo ``size``: equal keys share a
    shard, nulls hash like any value, repeated rows stay repeated, an empty
    table stays empty. Columns of ``df`` named like the two outputs (in any
    case of letters) are replaced.
    """
    names = list(shards)
    table = lookup_table(shards, size)
    key, value = fresh(df, "slot_key"), fresh(df, "shard_name")
    slots = df.sparkSession.createDataFrame([(i, names[s]) for i, s in enumerate(table.tolist())], f"`{key}` long, `{value}` string")
    at = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(size))
    out = {slot_col.lower(), shard_col.lower()}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in out]
    return df.withColumn(key, at).join(F.broadcast(slots), key).select(*kept, F.col(key).alias(slot_col), F.col(value).alias(shard_col))
