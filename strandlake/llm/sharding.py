"""Sharding by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a prime-sized table, from an offset
and a step drawn from its name. Shards take turns to claim their next free slot until the
table is full, so slots are dealt evenly, and a shard that joins or leaves moves few of them.
A row's slot is its key's hash modulo the table size; the table, of fixed size, is broadcast.

Defined results: a null key has a slot like any other value; equal keys share a shard; an empty
table gives no rows; all columns of the input stay, and one named slot or shard is replaced; repeated rows stay rows. Texts, of
any length, are not read but for n_chars in the report.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537


def table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """For each slot the number of the shard that claimed it."""
    if not shards:
        raise ValueError("no shards")
    if any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    drawn = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8]) % slots for d in drawn]
    step = [int.from_bytes(d[8:16]) % (slots - 1) + 1 for d in drawn]
    out, free = np.full(slots, -1, dtype=np.int32), slots
    while free:
        for k in range(len(shards)):
            while out[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            out[at[k]] = k
            free -= 1
            if not free:
                break
    return out


def placed(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with slot and shard."""
    owner = table(shards, slots)
    rows = df.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(owner.tolist())], "slot int, shard string")
    out = df.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int"))
    return out.join(F.broadcast(rows), "slot")  # as many rows as slots


def report(docs: DataFrame, n_shards: int = 64) -> DataFrame:
    names = [f"shard-{k:05d}" for k in range(n_shards)]
    return placed(docs.select("doc_id", F.length("text").alias("n_chars")), "doc_id", names).select("doc_id", "slot", "shard", "n_chars")
