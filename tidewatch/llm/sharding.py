"""Sharding: a lookup table that shards fill by taking turns (after the published Maglev hashing scheme)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHARDS, TABLE_SIZE = 64, 65537


def _preference(shard: str, size: int) -> tuple[int, int]:
    d = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of the shard. In each turn a shard claims the first free slot of its own permutation of the slots,
    (offset + j * skip) mod size; size is a prime, so each permutation meets every slot. Shares differ by one slot at most.
    The work depends on the size of the table alone, never on the data."""
    if size < 2 or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("needs distinct shards, no more than slots")
    prefer = [_preference(s, size) for s in shards]
    at = [offset for offset, _ in prefer]
    slots, left = [-1] * size, size
    while left:
        for i, (_, skip) in enumerate(prefer):
            while slots[at[i]] >= 0:
                at[i] = (at[i] + skip) % size
            slots[at[i]] = i
            left -= 1
            if not left:
                break
    return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key of any type; null keys share the slot of the empty string."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size))


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """df with slot (long) and shard (string) of each row.

    The broadcast table has exactly `size` rows whatever the data, so its bound is proven by the parameter. Rows are never
    moved to be placed: there is no shuffle, and hot keys cost nothing. Equal keys get equal shards; repeated rows are all
    kept. A column of df that is called slot or shard is replaced.
    """
    csv = ",".join(map(str, lookup_table(shards, size)))
    spark = df.sparkSession
    slots = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(csv), ",")).alias("_slot", "_shard"))
    names = F.array(*map(F.lit, shards))
    slots = slots.select(F.col("_slot").cast("long"), F.element_at(names, F.col("_shard").cast("int") + 1).alias("_shard"))
    rest = [F.col(c) for c in df.columns if c not in ("slot", "shard")]
    out = df.select(*rest, slot_of(F.col(key), size).alias("slot"))
    return out.join(F.broadcast(slots), out["slot"] == slots["_slot"]).drop("_slot").withColumnRenamed("_shard", "shard")


def moved(df: DataFrame, key: str, before: list[str], after: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The rows whose shard changes when the set of shards does, with old_shard and new_shard."""
    a = place(df, key, before, size).withColumnRenamed("shard", "old_shard").drop("slot")
    return place(a, key, after, size).withColumnRenamed("shard", "new_shard").filter("old_shard <> new_shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot, shard and size in bytes (0 for a null text); see `place`."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return place(sized, "doc_id", [f"shard-{i:03d}" for i in range(SHARDS)]).select("doc_id", "slot", "shard", "n_bytes")


#: the filled table is given as it is (tests hold its filling against the rule); slots, shards and sizes are worked out anew
OP10_SQL = f"""
WITH t AS (SELECT string_split('{",".join(map(str, lookup_table([f"shard-{i:03d}" for i in range(SHARDS)])))}', ',') AS shards),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {TABLE_SIZE} AS slot, coalesce(strlen(text), 0) AS n_bytes FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(shards[slot + 1], 3, '0') AS shard, n_bytes FROM d, t
"""
