"""Sharding by a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in its own order, a permutation given by an offset
and a step; shards take turns, each claiming the next slot of its order that is still free.  A key's
hash names a slot, the slot names the shard: constant time by a broadcast of the table, whose size is
the parameter ``slots``.  Adding or removing a shard moves few keys.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS, SLOTS = 64, 65537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard number of every slot; loads differ by one slot at most."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime number not below the number of shards")
    at, step = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % slots)
        step.append(int.from_bytes(digest[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1)
    table = np.full(slots, -1, np.int32)
    for claim in range(slots):
        shard = claim % len(shards)
        while table[at[shard]] >= 0:
            at[shard] = (at[shard] + step[shard]) % slots
        table[at[shard]] = shard
    return table


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: 60 bits of the SHA-256 of its text form; a null key counts as empty text."""
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def free_name(name: str, taken: list[str]) -> str:
    """A column name that none of ``taken`` has, whatever their case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def assign_shards(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``; no shuffle, so a hot source or key can't pile up.

    Rows of equal keys, repeated ones too, share a shard; a null key is placed like an empty text.  An
    empty table stays empty.  Columns of ``rows`` named slot or shard are replaced, the key too if it is one of
    them; all others, whatever their names, stay as they are.
    """
    table = lookup_table(shards, slots)
    at, slot, shard = (free_name(n, rows.columns) for n in ("_at", "_slot", "_shard"))
    found = rows.sparkSession.createDataFrame(
        [(i, shards[s]) for i, s in enumerate(table.tolist())], f"{at} int, {shard} string"
    )
    placed = rows.withColumn(slot, slot_of(F.col("`" + key.replace("`", "``") + "`"), slots)).drop("slot", "shard")
    # proven bound: the table has `slots` rows
    out = placed.join(F.broadcast(found), F.col(slot) == F.col(at), "left")
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in placed.columns if c != slot]
    return out.select(*kept, F.col(slot).alias("slot"), F.col(shard).alias("shard"))


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """Write rows placed by ``assign_shards`` as one folder per shard, each dealt over several files.

    All columns are written.  An empty table writes no shard.
    """
    deal = F.pmod(F.col("slot"), F.lit(files_per_shard))
    placed.repartition(F.col("shard"), deal).write.partitionBy("shard").parquet(path)
