"""Shard placement by a lookup table that shards fill in turns.

Each shard prefers the slots of a prime-sized table in an order of its own, a permutation given
by a start and a step. Shards take turns in claiming the first free slot they prefer until none
is free. A key's slot is its hash modulo the table's size, so placing takes constant time, shards
get equal shares, and few keys move when shards come or go.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the table, a prime. The table is broadcast and has this size for any input.
SLOTS = 65_537


def _numbers(shard: str) -> tuple[int, int]:
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:16], "big")


def fill_table(shards: dict[str, int], slots: int = SLOTS) -> list[str]:
    """The shard of each slot. A shard of weight w takes w turns in a row."""
    if not shards or min(shards.values()) < 1:
        raise ValueError("there must be shards, each with a weight of 1 or more")
    if len(shards) * max(shards.values()) > slots:
        raise ValueError("the table has too few slots for these shards")
    names = sorted(shards)
    at, steps, table, free = [], [], [None] * slots, slots
    for name in names:
        first, step = _numbers(name)
        at.append(first % slots)
        steps.append(step % (slots - 1) + 1)
    while True:
        for number, name in enumerate(names):
            for _ in range(shards[name]):
                while table[at[number]] is not None:
                    at[number] = (at[number] + steps[number]) % slots
                table[at[number]] = name
                free -= 1
                if not free:
                    return table


def place(rows: DataFrame, key: str, shards: dict[str, int], slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``, by the text of the ``key`` column.

    Equal keys share a shard; a null key counts as the empty text. Columns named ``slot`` or
    ``shard`` are replaced. An empty table stays empty.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame(list(enumerate(fill_table(shards, slots))), "slot int, shard string")
    slot = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(slots)).cast("int")
    return rows.drop("shard").withColumn("slot", slot).join(F.broadcast(table), "slot")
