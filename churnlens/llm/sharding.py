"""Permutation-filled lookup table (consistent sharding).

Every shard has a preference order over the slots of a prime-sized table, the
permutation ``offset + j * skip mod size``.  The shards take turns, each claiming
its most preferred free slot, until the table is full.  Shards then own almost
equal numbers of slots, and leaving one shard out moves few other slots.

The table depends on the shard names and the prime only, never on the data, so
its size is fixed (``size`` rows, a parameter) and it may be broadcast: placing a
row is one hash and one lookup, with no shuffle of the rows.

Defined results: a null key is hashed as the empty string; rows with equal keys
go to one shard; extra columns are kept (columns named ``slot`` or ``shard`` are
replaced); an empty input gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 6553  # prime, over 100 slots for each of 64 shards
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
MAX_TABLE = 1_000_003  # bound on the broadcast table's rows


def _digest(name: str, seed: str) -> int:
    return int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:12], 16)


def fill(shards=SHARDS, size: int = TABLE_SIZE) -> list[str]:
    """The owner of every slot."""
    shards = list(dict.fromkeys(shards))
    if not shards or not len(shards) <= size <= MAX_TABLE:
        raise ValueError(f"1 to {size} shards and a table of at most {MAX_TABLE} slots are needed")
    if any(size % k == 0 for k in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table size must be prime")
    owner: list[str | None] = [None] * size
    at = [_digest(s, "offset") % size for s in shards]
    skip = [_digest(s, "skip") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    left = size
    while left:
        for k, s in enumerate(shards):
            while owner[at[k]] is not None:
                at[k] = (at[k] + skip[k]) % size
            owner[at[k]] = s
            left -= 1
            if not left:
                break
    return owner


def lookup_table(spark: SparkSession, shards=SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    rows = list(enumerate(fill(shards, size)))
    return spark.createDataFrame(rows, "slot long, shard string")


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of its MD5, modulo the table size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size).cast("long"))


def assign(rows: DataFrame, key_col: str, shards=SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``."""
    rows = rows.drop("slot", "shard")
    owners = lookup_table(rows.sparkSession, shards, size)
    return rows.withColumn("slot", slot_of(F.col(f"`{key_col}`"), size)).join(F.broadcast(owners), "slot")


def write_shards(rows: DataFrame, key_col: str, path: str, files_per_shard: int = 8,
                 shards=SHARDS, size: int = TABLE_SIZE) -> None:
    """Write ``rows`` under ``path/shard=.../``.  A shard's rows are dealt over
    ``files_per_shard`` tasks by a second hash, so a hot key does not fill one."""
    placed = assign(rows, key_col, shards, size)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(files_per_shard))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
