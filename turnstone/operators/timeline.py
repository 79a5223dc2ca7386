"""Sequences of turns and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_order():
    """The window of a conversation's turns."""
    return W.partitionBy("conv_id").orderBy("turn")


def outline(turns: DataFrame) -> DataFrame:
    """Each turn with the roles around it and the characters so far."""
    return turns.select(
        "conv_id",
        "turn",
        "role",
        F.lag("role").over(in_order()).alias("prev_role"),
        F.lead("role").over(in_order()).alias("next_role"),
        F.sum(F.length("text")).over(in_order().rowsBetween(W.unboundedPreceding, 0)).alias("running_chars"),
    )


def gaps(turns: DataFrame) -> DataFrame:
    """Turns whose number doesn't follow the one before: the number before, and how many are missing."""
    before = turns.select("conv_id", "turn", F.lag("turn").over(in_order()).alias("prev_turn"))
    return before.where("turn - prev_turn > 1").withColumn("missing", F.col("turn") - F.col("prev_turn") - 1)


def transitions(turns: DataFrame) -> DataFrame:
    """How often each role follows each other one; null at a conversation's start."""
    pairs = turns.select(F.lag("role").over(in_order()).alias("from_role"), F.col("role").alias("to_role"))
    return pairs.groupBy("from_role", "to_role").agg(F.count("*").alias("n"))


def waits(events: DataFrame) -> DataFrame:
    """Microseconds since the same user's event before."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(order)
    return events.select("event_id", "user_id", F.timestamp_diff("MICROSECOND", before, F.col("ts")).alias("wait_us"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with gap or less between neighbours."""
    found = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def tumbling(events: DataFrame, width: str = "6 hours") -> DataFrame:
    """Events by type in windows of a width."""
    found = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("began"), "event_type", "n")
