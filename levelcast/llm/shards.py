"""Sharding by a lookup table that the shards fill in turns."""

import hashlib

from pyspark.sql import functions as F

from levelcast.llm.common import stable_hash

SLOTS = 6553  # prime, about 100 slots for each of 64 shards
SHARDS = 64


def _is_prime(n):
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name, slots):
    """Offset and step of a shard's walk over all slots."""
    digest = hashlib.md5(f"shard {name}".encode()).hexdigest()
    return int(digest[:15], 16) % slots, int(digest[15:30], 16) % (slots - 1) + 1


def lookup_table(shards, slots=SLOTS):
    """The shard name of every slot: in turns, each claims its next free preference.

    The number of slots is prime, so every walk visits all of them. Its size is a
    parameter, not a property of the data.
    """
    shards = sorted(set(shards))
    if not _is_prime(slots) or len(shards) > slots or not shards:
        raise ValueError("slots must be prime and no fewer than the shards, of which there is one at least")
    walks = [preference(name, slots) for name in shards]
    at = [0] * len(shards)
    owner, free = [None] * slots, slots
    while free:
        for k, (offset, step) in enumerate(walks):
            while owner[slot := (offset + at[k] * step) % slots] is not None:
                at[k] += 1
            owner[slot] = shards[k]
            free -= 1
            if not free:
                break
    return owner


def place(docs, shards=range(SHARDS), slots=SLOTS):
    """Add `shard` to every row by one hash and one look into the broadcast table.

    The key is doc_id, and the text where doc_id is NULL, so that rows without an
    id spread as well; rows equal in both share a shard. A column `shard` of the
    input is replaced; all other columns stay. Adding or removing one shard
    leaves nearly all other rows where they are. Nothing is shuffled; the table
    has `slots` rows and is the only thing broadcast.
    """
    spark = docs.sparkSession
    owners = lookup_table(shards, slots)
    pairs = spark.range(slots).select(
        F.col("id").cast("int").alias("__slot"),
        F.get(F.split(F.lit(",".join(map(str, owners))), ","), F.col("id").cast("int")).cast("int").alias("shard"),
    )
    key = F.when(F.col("doc_id").isNull(), stable_hash(F.col("text"))).otherwise(stable_hash(F.col("doc_id")))
    keyed = docs.drop("shard").withColumn("__slot", F.pmod(key, F.lit(slots)).cast("int"))
    return keyed.join(F.broadcast(pairs), "__slot").drop("__slot")


def write_shards(placed, path, rows_per_file=1_000_000):
    """One folder per shard. A rebalance sizes the files and splits a large shard."""
    placed.hint("rebalance", "shard").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
