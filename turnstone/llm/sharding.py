"""Sharding by weighted rendezvous hashing, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_counted


def _digest(key: Column, salt) -> Column:
    """48 pseudorandom bits of a key and a salt, the same on every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", key, salt)), 1, 12), 16, 10).cast("bigint")


def _race(key: Column, shard: Column, weight: Column) -> Column:
    """The shard's finishing time for a key: exponential, with the weight as its rate."""
    return -F.log((_digest(key, shard.cast("string")) + 0.5) / float(1 << 48)) / weight


def place(key: Column, weights: list[float], first: int = 0) -> Column:
    """struct(time, shard) of the shard that wins a key, of shards first, first + 1, ...

    Each shard wins a share of the keys in proportion to its weight. A shard's time
    depends on the key and on itself alone: adding a shard moves only the keys that
    it wins, dropping one only those that it had. Ties go to the smaller shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above 0, one for each shard")
    times = F.transform(F.array(*map(F.lit, map(float, weights))), lambda w, i: F.struct(_race(key, i + first, w).alias("time"), (i + first).cast("int").alias("shard")))
    return F.array_min(times)


def shard_rows(docs: DataFrame, weights: list[float], grown_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """A row (id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs.

    size: UTF-8 bytes of the text plus 8. shard: the winner among the weights.
    grown_shard: the same with one more shard of grown_weight. slot: the row's number
    in its shard, from 0 without gaps, in the order of a pseudorandom part of the id,
    the checksum and the size, and of these; parts are numbered apart and then offset, so
    a shard is never sorted in one task. parts: how many a shard has; about as many as a
    part has rows, if none are given.

    A null text has no bytes (checksum 0). A null id has the key '', so such rows
    share a shard, but not a part. Repeated rows each get a slot of their own, given by one task. A very long text
    is looked at whole; it has to fit into a task. An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    key, text = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    won, late = place(key, weights), place(key, [grown_weight], first=len(weights))
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 8).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            won.alias("won"),
            late.alias("late"),
            key.alias("key"),
        ).select("id", "size", "text_crc32", _digest(F.concat_ws("/", "key", "text_crc32", "size"), F.lit("part")).alias("part"), F.col("won.shard").alias("shard"), F.least("won", "late").getField("shard").alias("grown_shard"))
    )
    n = rows.count()
    rows = rows.withColumn("part", F.col("part") % (parts or math.ceil(math.sqrt(n / len(weights))) or 1))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("shard", "part").orderBy(F.col("id").asc_nulls_first(), "text_crc32", "size")
    numbered = join_counted(rows.withColumn("rank", F.row_number().over(within)), cut(offsets), ["shard", "part"], "inner")
    slot = (F.col("offset") + F.col("rank") - 1).cast("bigint").alias("slot")
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
