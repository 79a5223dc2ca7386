"""Summaries and searches over conversations and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnstone.functions.text import holds, n_lines, n_words, snippet


def by_path(records: DataFrame, body: str, path: str, kind: str = "string", name: str = "value") -> DataFrame:
    """records with a column of that name (in place of one that has it): what a JSON path of the text column body holds."""
    return records.withColumn(name, F.try_variant_get(F.try_parse_json(body), path, kind))


def search(turns: DataFrame, needle: str, around: int = 20) -> DataFrame:
    """The turns that hold needle, letter case aside, each with a snippet around it."""
    return turns.where(holds(F.col("text"), needle)).withColumn("snippet", snippet(F.col("text"), needle, around))


def search_pattern(turns: DataFrame, pattern: str) -> DataFrame:
    """The turns whose text a regular expression matches somewhere, with the number of matches."""
    return turns.where(F.col("text").rlike(pattern)).withColumn("matches", F.regexp_count("text", F.lit(pattern)))


def summary(turns: DataFrame) -> DataFrame:
    """A row per conversation: turns, characters, longest text and turns by the user."""
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"), F.count(F.when(F.col("role") == "user", 1)).alias("user_turns")
    )


def counts_over_time(events: DataFrame, unit: str = "DAY") -> DataFrame:
    """Events by type in each unit of time, in the type of their timestamps."""
    kind = events.schema["ts"].dataType
    return events.groupBy(F.date_trunc(unit, "ts").cast(kind).alias("at"), "event_type").agg(F.count("*").alias("n"))


def duplicates(turns: DataFrame) -> DataFrame:
    """Texts that occur more than once, by their digest."""
    return turns.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv")).where("n > 1")


def key_inventory(records: DataFrame, body: str) -> DataFrame:
    """How many records have each top-level key of a JSON text column."""
    return records.select(F.explode(F.json_object_keys(body)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def value_types(records: DataFrame, body: str, path: str) -> DataFrame:
    """How many records hold each kind of value at a path: number, string, boolean, null, array, object or absent."""
    found = F.try_variant_get(F.try_parse_json(body), path, "variant")
    name = F.schema_of_variant(found)
    kind = (
        F.when(found.isNull(), "absent")
        .when(name == "VOID", "null")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object")
        .otherwise("number")
    )
    return records.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def merged_schema(records: DataFrame, body: str) -> DataFrame:
    """One row: the schema that all objects of a JSON text column share."""
    parsed = F.try_parse_json(body)
    return records.select(parsed.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT")).agg(F.schema_of_variant_agg("v").alias("merged"))


def subtotals(turns: DataFrame, *keys: str) -> DataFrame:
    """Turns and characters for every combination of keys, with the grouping id."""
    return turns.cube(*keys).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def quantiles(turns: DataFrame, shares: list[float]) -> DataFrame:
    """Exact quantiles of the text length by role, to six decimals."""
    return turns.groupBy("role").agg(*[F.round(F.percentile(F.length("text"), F.lit(q)), 6).alias(f"q{round(100 * q)}") for q in shares])


def distinct_estimate(turns: DataFrame, error: float = 0.02) -> DataFrame:
    """An estimate of the number of different texts by role."""
    return turns.groupBy("role").agg(F.approx_count_distinct("text", error).alias("texts"))


def role_lists(turns: DataFrame) -> DataFrame:
    """A conversation's roles, in the order of its turns."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["role"]), ",").alias("roles"))


def role_pivot(turns: DataFrame, roles: list[str]) -> DataFrame:
    """A conversation's characters by role, a column each."""
    return turns.groupBy("conv_id").pivot("role", roles).agg(F.sum(F.length("text")))


def unanswered(turns: DataFrame) -> DataFrame:
    """User turns after which their conversation has no assistant turn."""
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    asked = turns.where("role = 'user'").select("conv_id", "turn").join(last, "conv_id", "left")
    return asked.where("last IS NULL OR last < turn").select("conv_id", "turn")


def longest(turns: DataFrame, k: int) -> DataFrame:
    """The k longest texts of each conversation; of equal ones the earlier."""
    order = W.partitionBy("conv_id").orderBy(F.length("text").desc(), "turn")
    ranked = turns.select("conv_id", F.row_number().over(order).alias("rank"), "turn", F.length("text").alias("chars"))
    return ranked.where(F.col("rank") <= k)


def sizes(turns: DataFrame) -> DataFrame:
    """Characters, bytes, words and lines of each text."""
    text: Column = F.col("text")
    return turns.select("conv_id", "turn", F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), n_words(text).alias("words"), n_lines(text).alias("lines"))


def unfolded(records: DataFrame, key: str, body: str) -> DataFrame:
    """A row per element of the object or array in a JSON text column: its key (or position) and value."""
    parsed = records.select(F.col(key).alias("_key"), F.try_parse_json(body).alias("_body"))
    unfolded = parsed.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("_body").outer()))
    return unfolded.select(F.col("_key").alias(key), "pos", F.col("key").alias("name"), F.to_json("value").alias("json"))
