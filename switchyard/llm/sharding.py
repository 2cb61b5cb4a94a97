"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table whose
size is a prime; the shards take turns claiming their next free slot until
all are taken.  A row's place is one lookup: the slot that its key hashes to.
Shares differ by at most one slot, and a shard that leaves moves few rows
that were not its own.  The table has a fixed size and is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537  # prime; about a hundred slots for each of 600 shards


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The number (place in ``shards``) of the shard of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards are distinct names, one at least")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the number of slots is a prime, and no less than that of the shards")
    seeds = [hashlib.sha256(s.encode()).digest() for s in shards]
    first = [int.from_bytes(d[:8], "big") % slots for d in seeds]
    step = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in seeds]
    out, at, taken = [-1] * slots, list(first), 0
    while True:
        for shard in range(len(shards)):
            slot = at[shard]
            while out[slot] >= 0:
                slot = (slot + step[shard]) % slots
            out[slot] = shard
            at[shard] = (slot + step[shard]) % slots
            taken += 1
            if taken == slots:
                return np.array(out, np.int64)


def slot_of(key: Column, otherwise: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; rows without a key are dealt by ``otherwise``, not all to one slot."""
    return F.pmod(F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(otherwise)), F.lit(slots)).cast("int")


def placed(docs: DataFrame, shards: list[str], key: str = "doc_id", otherwise: str = "text", slots: int = SLOTS) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (both replaced, if there).

    Equal keys have one place; a null key is placed by ``otherwise`` (null as
    well: one slot).  No shuffle: the table is broadcast.
    """
    table = _table(docs.sparkSession, shards, slots)
    kept = docs.select(*[F.col(c) for c in docs.columns if c not in ("slot", "shard")])
    marked = kept.withColumn("slot", slot_of(F.col(key), F.col(otherwise), slots))
    return marked.join(F.broadcast(table), "slot").select(*kept.columns, "slot", "shard")


def _table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    names = np.array(shards, object)[lookup_table(shards, slots)]
    return spark.createDataFrame(pd.DataFrame({"slot": np.arange(slots, dtype=np.int32), "shard": names}), "slot int, shard string")


def write_sharded(docs: DataFrame, shards: list[str], path: str, key: str = "doc_id", otherwise: str = "text", files: int = 8) -> None:
    """One folder for each shard, each written by up to ``files`` tasks; its rows are not sorted."""
    marked = placed(docs, shards, key, otherwise)
    marked.repartition("shard", F.pmod("slot", F.lit(files))).write.mode("overwrite").partitionBy("shard").parquet(path)
