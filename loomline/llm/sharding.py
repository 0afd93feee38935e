"""Sharding by jump consistent hashing (operator 5), in built-in functions only.

A key's shard follows from the key and the number of shards: the key seeds a
64-bit linear congruential generator whose draws say to which shard the key
jumps next, and the last jump below the number of shards is the shard.  There
is no ring table, and one more shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: The multiplier of the generator of jump consistent hashing, as high and low 32 bits.
MULTIPLIER = 2862933555777941757
_M_HIGH, _M_LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF


def _draw(state: Column) -> tuple[Column, Column]:
    """The generator's next state, key * MULTIPLIER + 1 mod 2**64, in 16- and 32-bit parts that no long overflows."""
    high, low = state["hi"], state["lo"]
    mask = F.lit(0xFFFFFFFF)
    low0, low1 = low.bitwiseAND(F.lit(0xFFFF)), F.shiftright(low, 16)
    first, second = low0 * F.lit(_M_LOW), low1 * F.lit(_M_LOW)
    total = first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)

    def times(part: Column, factor: int) -> Column:  # mod 2**32
        upper = F.shiftright(part, 16) * F.lit(factor)
        return (part.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(mask)

    carried = F.shiftright(total, 32) + F.shiftright(second, 16) + times(high, _M_LOW) + times(low, _M_HIGH)
    return carried.bitwiseAND(mask), total.bitwiseAND(mask)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of a long key; a null key counts as 0.

    A jump is always forwards, so ``shards`` draws reach the end for every key.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
        F.shiftright(key, 32).bitwiseAND(F.lit(0xFFFFFFFF)).alias("hi"), key.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _draw(state)
        reach = (state["j"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + F.lit(1)).cast("double"))
        jumped = F.struct(state["j"].alias("b"), F.floor(reach).cast("long").alias("j"), high.alias("hi"), low.alias("lo"))
        return F.when(state["j"] < F.lit(shards), jumped).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    law is ``key``.  size is the text's UTF-8 bytes (null: none) plus 1, and
    text_crc32 that of an empty text where it is null.  slot numbers each
    shard's rows from 0 without gaps in order of doc_id (nulls last), size and
    text_crc32; rows equal in all three take neighbouring slots in any order.
    grown_shard is the shard under one shard more.  Other columns are ignored.

    No shard is numbered in one task: range partitions over (shard, doc_id)
    are counted, the counts are summed up shard by shard, and each range
    numbers its own rows from there.  The text itself is never shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col).cast("long")
    light = docs.select(
        key.alias("doc_id"), (F.octet_length(text).cast("long") + F.lit(1)).alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        jump_shard(key, shards).alias("shard"), jump_shard(key, shards + 1).alias("grown_shard"),
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("text_crc32")]
    ranged = light.repartitionByRange(F.col("shard"), *order).withColumn("part", F.spark_partition_id())
    staged = scratch.stage(ranged, "op5")
    counts = staged.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = staged.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)))
    # A range holds at most all shards and, together, ranges and shards bound the rows of ``starts``: it is broadcast.
    joined = numbered.join(F.broadcast(starts), ["shard", "part"])
    return joined.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("rank") - F.lit(1)).cast("long").alias("slot"), "grown_shard",
    )
