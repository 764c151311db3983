"""Sharding through a permutation-filled lookup table (consistent hashing with a prime-sized table).

Every shard has its own permutation of the table's slots, made from two hashes of its name. The shards
take turns, and each turn claims the first slot of the shard's permutation that is still free, until no
slot is free. A key goes to the shard that owns slot ``hash(key) mod size``: one lookup, no shuffle.
Shards own almost equal numbers of slots, and adding or removing one moves few keys between the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots for each shard at least; the shares of two shards then differ by about one in a hundred.
SLOTS_PER_SHARD = 100
#: A table holds at most this many slots, so that what is broadcast stays under about 16 MB.
MAX_SLOTS = 1_000_003
HASH_DIGITS = 15  # hexadecimal digits of MD5, 60 bits: they fit a signed 64-bit integer


def _hash(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:HASH_DIGITS], 16)


def hash_column(text: Column) -> Column:
    """60 bits of MD5 as a long; the same in every engine."""
    return F.conv(F.substring(F.md5(text.cast("string")), 1, HASH_DIGITS), 16, 10).cast("long")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def table_size(n_shards: int) -> int:
    """The least prime that gives each shard SLOTS_PER_SHARD slots; at most MAX_SLOTS."""
    n = max(n_shards * SLOTS_PER_SHARD, 2)
    while not is_prime(n):
        n += 1
    if n > MAX_SLOTS:
        raise ValueError(f"{n_shards} shards need {n} slots; a table has {MAX_SLOTS} at most")
    return n


def lookup_table(shards: Sequence[str], size: int | None = None) -> list[int]:
    """The number of the owning shard for each slot. Expected work is size * log(size)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    size = size or table_size(len(shards))
    if not is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime not below the number of shards")
    offset = [_hash(f"{name}#offset") % size for name in shards]
    skip = [_hash(f"{name}#skip") % (size - 1) + 1 for name in shards]
    owner, taken = [-1] * size, 0
    at = list(offset)
    while True:
        for shard in range(len(shards)):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + skip[shard]) % size
            owner[slot] = shard
            at[shard] = (slot + skip[shard]) % size
            taken += 1
            if taken == size:
                return owner


def assign_shards(df: DataFrame, key: str, shards: Sequence[str], size: int | None = None) -> DataFrame:
    """df with the columns ``slot`` (int) and ``shard`` (string) for each row.

    A null key counts as the empty string. Equal keys go to equal shards, so repeated rows stay together;
    an empty table gives an empty result; columns of df that are named slot or shard are replaced. The
    lookup table has at most MAX_SLOTS rows and is broadcast.
    """
    owner = lookup_table(shards, size)
    spark = df.sparkSession
    table = F.broadcast(
        spark.createDataFrame([(i, shards[s]) for i, s in enumerate(owner)], "__slot int, __shard string")
    )
    rest = df.drop("slot", "shard")
    slot = F.pmod(hash_column(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(len(owner))).cast("int")
    placed = rest.withColumn("slot", slot)
    return placed.join(table, placed["slot"] == table["__slot"]).drop("__slot").withColumnRenamed("__shard", "shard")


def sharding_sql(relation: str, key: str, columns: str, shards: Sequence[str]) -> str:
    """DuckDB SQL that fills the table by recursion, one turn a level, and places the rows of relation."""
    size, n = table_size(len(shards)), len(shards)
    names = ", ".join(f"'{s}'" for s in shards)

    def sql_hash(text: str) -> str:
        return f"('0x' || substr(md5({text}), 1, {HASH_DIGITS}))::BIGINT"

    return f"""
WITH RECURSIVE names AS (SELECT [{names}] AS v),
params AS (SELECT list_transform(v, lambda s: {sql_hash("s || '#offset'")} % {size}) AS o,
                  list_transform(v, lambda s: {sql_hash("s || '#skip'")} % {size - 1} + 1) AS k FROM names),
fill(turn, owner) AS (
  SELECT 0, list_transform(range({size}), lambda i: -1)
  UNION ALL
  SELECT turn + 1, list_transform(owner, lambda x, i: CASE WHEN i - 1 = slot THEN turn % {n} ELSE x END)
  FROM (SELECT turn, owner, list_filter(
          list_transform(range({size}), lambda j: (o[turn % {n} + 1] + j * k[turn % {n} + 1]) % {size}),
          lambda s: owner[s + 1] < 0)[1] AS slot
        FROM fill, params WHERE turn < {size})),
slots AS (SELECT unnest(range({size})) AS slot, unnest(owner) AS shard_no FROM fill WHERE turn = {size})
SELECT {columns}, CAST(t.slot AS INTEGER) AS slot, v[shard_no + 1] AS shard
FROM (SELECT *, {sql_hash(f"coalesce(CAST({key} AS VARCHAR), '')")} % {size} AS slot FROM {relation}) t
JOIN slots USING (slot), names"""
