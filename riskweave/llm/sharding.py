"""Placing documents on shards through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: it
starts at one slot and goes on in equal steps. Shards take turns claiming their next free
slot until all are taken. A document hashes to a slot and goes to the slot's owner; adding
or removing a shard moves few documents. The table has a fixed size and is broadcast, so
placing needs no shuffle.

A null key goes where the empty string goes. Equal keys go to the same shard. Repeated
rows stay repeated. All columns are kept; ``shard`` replaces a column so named.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from .common import table

SHARDS = 32
#: A prime over 100 times the number of shards: no shard owns a hundredth more than another.
TABLE_SIZE = 4093


def hashed(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The owner of each slot."""
    if size < len(shards) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime not below the number of shards")
    at = [hashed(f"{s}-offset") % size for s in shards]
    step = [hashed(f"{s}-skip") % (size - 1) + 1 for s in shards]
    owner, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def shard_names(number: int) -> list[str]:
    return [f"shard-{k}" for k in range(number)]


def place(docs: DataFrame, key: str = "doc_id", shards: list[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with ``shard``, the number of the shard that owns the key's slot."""
    owner = fill(shards or shard_names(SHARDS), size)
    slots = docs.sparkSession.createDataFrame(list(enumerate(owner)), "_s_slot long, shard int")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % size
    return docs.drop("shard").withColumn("_s_slot", slot).join(F.broadcast(slots), "_s_slot").drop("_s_slot")


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return place(docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes")))


def sql(shards: int = SHARDS, size: int = TABLE_SIZE) -> str:
    """The same in DuckDB: one claim a step."""
    number = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE prefs AS MATERIALIZED (
  SELECT shard, list((o + j * s) % {size} ORDER BY j) AS slots
  FROM (SELECT shard, {number.format("'shard-' || shard || '-offset'")} % {size} AS o,
               {number.format("'shard-' || shard || '-skip'")} % {size - 1} + 1 AS s
        FROM range({shards}) r(shard)), range({size}) t(j)
  GROUP BY shard),
claims(step, owner) AS (
  SELECT 0, [-1 FOR x IN range({size})]
  UNION ALL
  SELECT step + 1, owner[:slot] || [(step % {shards})::INT] || owner[slot + 2:]
  FROM (SELECT step, owner, list_filter(slots, lambda x: owner[x + 1] = -1)[1] AS slot
        FROM claims JOIN prefs ON shard = step % {shards} WHERE step < {size})),
filled AS (SELECT unnest(range({size})) AS slot, unnest(owner) AS shard FROM claims WHERE step = {size})
SELECT d.doc_id, d.bytes, f.shard::INTEGER AS shard
FROM (SELECT doc_id, strlen(text)::BIGINT AS bytes, {number.format("coalesce(doc_id::VARCHAR, '')")} % {size} AS slot FROM documents) d
JOIN filled f USING (slot)"""
