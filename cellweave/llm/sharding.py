"""Consistent placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: a full-period walk
``(offset + j * skip) mod size`` whose offset and skip come from a digest of the shard's name. The shards take
turns, each claiming its most preferred slot that is still free, until the table is full. A key then costs one
hash and one table look-up; shards own equal shares to within one slot, and adding or removing a shard moves few
other keys.

Defined cases: a null key has the placement of Spark's hash of null; repeated rows are placed alike; an empty table
gives no row; further columns are kept, whatever their names; the caller names the two new ones, whose names must not be
taken (ValueError).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import set_apart

#: A prime; its rows are the proven bound of what is broadcast. With 64 shards a share is off by 0.1 % at most.
TABLE_SIZE = 65537
N_SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Slot -> index of the shard that owns it."""
    if not _is_prime(size):
        raise ValueError("the table size must be a prime")
    if not 0 < len(shards) <= size or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, and at least one and at most as many as slots")
    owner = np.full(size, -1, np.int32)
    walk = []
    for name in shards:
        digest = hashlib.blake2b(name.encode(), digest_size=16).digest()
        walk.append([int.from_bytes(digest[:8], "little") % size, int.from_bytes(digest[8:], "little") % (size - 1) + 1])
    filled = 0
    while filled < size:
        for shard, at in enumerate(walk):
            slot, skip = at
            while owner[slot] >= 0:
                slot = (slot + skip) % size
            owner[slot] = shard
            at[0] = (slot + skip) % size
            filled += 1
            if filled == size:
                break
    return owner


def assign_shards(
    df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, names: tuple[str, str] = ("slot", "shard")
) -> DataFrame:
    """``df`` with two columns, a slot (long) and its shard (string), by a broadcast join on the filled table."""
    if taken := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"column names are taken: {sorted(taken)}")
    inner = set_apart(df, key)
    inner = inner.withColumnRenamed(key, "key")
    owner = fill_table(shards, size)
    lookup = df.sparkSession.createDataFrame(
        pd.DataFrame({"slot": np.arange(size, dtype=np.int64), "shard": np.array(shards, dtype=object)[owner]}),
        "slot long, shard string",
    )
    slotted = inner.withColumn("slot", F.pmod(F.xxhash64(F.col("key")), F.lit(size)).cast("long"))
    placed = slotted.join(F.broadcast(lookup), "slot", "inner")
    return placed.select(*inner.columns, "slot", "shard").toDF(*df.columns, *names)


def write_shards(df: DataFrame, key: str, path: str, shards: list[str], files_per_shard: int = 1) -> None:
    """Write ``df`` partitioned by shard. Rows are dealt by shard and a salt of the slot, so no task holds a whole shard
    unless ``files_per_shard`` is 1."""
    placed = assign_shards(df, key, shards)
    salt = F.pmod(F.xxhash64("slot"), F.lit(files_per_shard))
    (
        placed.repartition(len(shards) * files_per_shard, F.col("shard"), salt)
        .drop("slot")
        .write.partitionBy("shard")
        .mode("overwrite")
        .parquet(path)
    )


def shard_names(n: int = N_SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement of every row of documents: doc_id, n_chars, slot, shard."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "n_chars")
    return assign_shards(docs, "doc_id", shard_names())
