"""Consistent sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size, and
shards take turns claiming the first free slot of their order.  A key goes to the shard of
slot hash(key) mod size.  Shares differ by a slot at most, and a change of the shards moves
few keys besides those of the shard that came or went.  The table has `size` rows, a fixed
parameter, so it is safe to broadcast; a row costs one hash and one lookup, with no shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime over 100 times the default shards.
SIZE = 6553
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def lookup_table(shards=SHARDS, size: int = SIZE) -> list[int]:
    """The place in `shards` of the owner of each slot."""
    if not shards or len(set(shards)) != len(shards) or size < len(shards) or any(size % i == 0 for i in range(2, int(size**0.5) + 1)):
        raise ValueError("shards must be different names and size a prime of at least as many")

    def number(name: str, salt: str, below: int) -> int:
        return int(hashlib.sha256(f"{salt}:{name}".encode()).hexdigest()[:15], 16) % below

    order = [(number(s, "offset", size), 1 + number(s, "skip", size - 1)) for s in shards]
    owner, turn = [-1] * size, [0] * len(shards)
    left = size
    while True:
        for i, (offset, skip) in enumerate(order):
            while owner[slot := (offset + turn[i] * skip) % size] >= 0:
                turn[i] += 1
            owner[slot] = i
            left -= 1
            if not left:
                return owner


def assign_shards(docs: DataFrame, key_col: str = "doc_id", shards=SHARDS, size: int = SIZE) -> DataFrame:
    """Adds slot (int) and shard (name) to every row by its key, written as a string.

    Equal keys go to one shard; null keys count as the empty string; input columns called
    slot or shard are replaced.  Empty input: empty.  A shard may hold a hot key whole; give
    a key with more parts where that matters.
    """
    spark = docs.sparkSession
    owner = ",".join(map(str, lookup_table(shards, size)))
    names = ",".join("'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'" for s in shards)
    table = spark.sql(
        f"SELECT CAST(slot AS INT) AS slot, element_at(array({names}), CAST(o AS INT) + 1) AS shard "
        f"FROM (SELECT posexplode(split('{owner}', ',')) AS (slot, o))"
    )
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    slot = F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")
    columns = [c for c in docs.columns if c not in ("slot", "shard")]
    return docs.withColumn("slot", slot).drop("shard").join(F.broadcast(table), "slot").select(*columns, "slot", "shard")
