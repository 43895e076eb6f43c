"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table (an offset and a step from a hash of its
name); shards take turns, each claiming the first free slot of its order, until the table is full. Shares differ by one slot
at most, and removing a shard moves few keys besides its own. A key's place is one look-up: the slot of its hash.

The table has a fixed number of slots, so its broadcast is bounded by ``SLOTS`` rows of two integers, whatever the data.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, over a hundred slots for each of the shards.
SLOTS = 6553
SHARDS = 64
#: The largest table that is broadcast: 12 bytes a row, 12 MB.
MOST_SLOTS = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot, the place in ``names`` of the shard that has claimed it."""
    if not names or len(names) > slots or slots > MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime, no more than MOST_SLOTS, and no fewer than the shards")
    at = [_number("offset:" + x) % slots for x in names]
    step = [_number("step:" + x) % (slots - 1) + 1 for x in names]
    owner, free = [-1] * slots, slots
    while True:
        for k in range(len(names)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def lookup_table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) of the filled table; the plan holds it as one literal."""
    owners = F.from_json(F.lit(json.dumps(fill(names, slots))), "array<int>")
    return spark.range(1, numPartitions=1).select(F.posexplode(owners).alias("slot", "shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: its MD5's first 60 bits, modulo the table's size. A null key counts as an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def shard_names(shards: int) -> list[str]:
    return [f"shard-{k}" for k in range(shards)]


def place(rows: DataFrame, key_col: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """One row per input row: the key, its slot and its shard.

    Equal keys, repeated rows included, have equal places; null keys share one place; keys of any length are hashed whole; an empty
    table gives no rows; other columns are ignored, whatever their names. Keys meet the table by a broadcast join, so no row is
    shuffled and hot keys do no harm. A key column that is itself called slot or shard keeps its name and stands first.
    """
    table = lookup_table(rows.sparkSession, shard_names(shards), slots)
    key = F.col(f"`{key_col}`")
    joined = rows.select(key.alias("_key"), slot_of(key, slots).alias("slot")).join(F.broadcast(table), "slot")
    return joined.select("_key", "slot", "shard").toDF(key_col, "slot", "shard")
