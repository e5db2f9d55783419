"""Sharding by jump consistent hashing, in DataFrame functions only.

A row's shard follows from its identifier and the number of shards alone (law ``key``). The jump
recurrence draws b(0) < b(1) < ... until the next one passes the shard count; its pseudo-random
draws are ``xxhash64(identifier, step)``, so there is no ring table and no state, and one more
shard takes rows only into itself.

Slots number the rows of a shard from 0 without gaps. A shard is numbered in buckets (by a hash of
the identifier and the text's crc), so no task holds a whole shard, nor all rows of a repeated identifier; the buckets' first slots come from a table of
shards x buckets counts.

Null text has no bytes (size 1, crc32 0). A null identifier goes to the shard that ``xxhash64`` of
null gives. Repeated rows get slots of their own. Extra columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrvox.llm.common import partitions


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of ``key`` (shards from 1 to 2**31 - 1 that jump: at most ``shards`` steps)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(acc: Column, i: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, i), 33) + F.lit(1).cast("long")
        jump = F.floor((acc["j"] + 1) * (F.lit(float(1 << 31)) / draw)).cast("long")
        return F.when(acc["j"] >= shards, acc).otherwise(F.struct(acc["j"].alias("b"), jump.alias("j")))

    # Each step raises b by one at least, so ``shards`` steps always suffice.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["b"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    buckets = buckets or max(1, -(-2 * partitions(spark) // shards))
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    key = F.col("doc_id")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    ).select(
        "*",
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.col("text_crc32"), F.lit(buckets)), F.lit(buckets)).cast("int").alias("bucket"),
    )
    counts = rows.groupBy("shard", "bucket").count()
    first = counts.select(
        "shard", "bucket",
        (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("first_slot"),
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("n", F.row_number().over(within) - 1)
        .join(F.broadcast(first), ["shard", "bucket"])  # shards x buckets rows
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first_slot") + F.col("n")).cast("long").alias("slot"), "grown_shard")
    )
