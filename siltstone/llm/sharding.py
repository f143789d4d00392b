"""Shard placement by a permutation-filled lookup table of prime size.

Every shard has its own preference order over the slots of the table, an arithmetic walk whose start
and step come from a hash of the shard's name. Shards take turns; at its turn a shard claims the first
free slot of its order. The table is then a constant-time map from a key's hash to a shard: shares
differ by at most one slot, and a shard that joins or leaves moves few other keys.

The table has ``table_size`` entries, a parameter checked against ``MAX_TABLE``, whatever the data's
size, so it is broadcast. No row is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
MAX_TABLE = 2_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, size: int) -> tuple[int, int]:
    """First slot and step of a shard's walk; any step under a prime size visits every slot."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1


def fill_table(names: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Slot -> index into ``names``."""
    if not is_prime(size) or size > MAX_TABLE:
        raise ValueError(f"the table size must be a prime of at most {MAX_TABLE}")
    if not names or len(names) > size or len(set(names)) != len(names):
        raise ValueError("there must be 1 to table-size shards with distinct names")
    table = np.full(size, -1, dtype=np.int32)
    walks = [preference(n, size) for n in names]
    at = [start for start, _ in walks]
    claimed = 0
    while claimed < size:
        for shard, (_, step) in enumerate(walks):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + step) % size
            table[slot] = shard
            at[shard] = (slot + step) % size
            claimed += 1
            if claimed == size:
                break
    return table


def key_slot(key, size: int):
    """Slot of a key column: 60 bits of an MD5 of its text, modulo the table size; null is the text ''."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size))


def assign_shards(df: DataFrame, key: str, shards: int | list[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` (long) and ``shard`` (int) columns; input columns of those names are replaced.

    Rows with a null key go where the empty string goes, equal keys go to one shard, repeated rows
    stay repeated, and an empty input gives an empty result.
    """
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    table = fill_table(names, table_size)
    lookup = df.sparkSession.createDataFrame(
        pd.DataFrame({"__slot": np.arange(table_size, dtype=np.int64), "__shard": table}), "__slot long, __shard int"
    )
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    placed = df.withColumn("__key", key_slot(F.col(key), table_size))
    joined = placed.join(F.broadcast(lookup), F.col("__key") == F.col("__slot"), "left")
    return joined.select(*kept, F.col("__key").alias("slot"), F.col("__shard").alias("shard"))
