"""Helpers shared by the operators: guarded broadcasts, components."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.plans.scratch import FILE_ROWS, Recorded, cut, drop_scratch, scratch_dir  # noqa: F401

#: The word separators of every operator: the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only if it was counted, and has at most so many rows and so many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Bytes that a column takes in a row, as far as its type tells.
FIXED_BYTES = {"boolean": 1, "int": 4, "bigint": 8, "double": 8, "float": 4}


def join_counted(big: DataFrame, small: DataFrame, on, how: str = "left", rows: int | None = None) -> DataFrame:
    """Join with small (a table from cut(), so that counting it is cheap).

    It is broadcast if it has at most BROADCAST_ROWS rows, and BROADCAST_BYTES in columns whose
    length isn't fixed (rows, if given, is the number of rows of one that has only fixed ones); else the join shuffles,
    and adaptive execution splits the partitions of hot keys.
    """
    open_ended = [c for c, kind in small.dtypes if kind not in FIXED_BYTES]
    if rows is None:
        width = sum((_bytes(small.schema[c].dataType, F.col(c)) for c in open_ended), F.lit(0).cast("bigint"))
        rows, held = small.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    else:
        held = 0
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES else small, on, how)


def _bytes(kind: T.DataType, value: Column) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, T.ArrayType):
        inner = FIXED_BYTES.get(kind.elementType.simpleString())
        each = F.size(value).cast("bigint") * inner if inner else F.aggregate(value, F.lit(0).cast("bigint"), lambda a, x: a + _bytes(kind.elementType, x))
    elif isinstance(kind, T.StructType):
        each = sum((_bytes(f.dataType, value[f.name]) for f in kind.fields), F.lit(0).cast("bigint"))
    else:
        each = F.octet_length(value).cast("bigint") if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(FIXED_BYTES.get(kind.simpleString(), 16)).cast("bigint")
    return F.coalesce(each, F.lit(0).cast("bigint"))


def slices(lengths, most: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring rows whose lengths sum up to about `most` at most, or hold one row."""
    if not len(lengths):
        return []
    group = np.cumsum(np.array(lengths, dtype=np.int64)) // most
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist()]
    return list(zip(starts, [*starts[1:], len(lengths)]))


#: Rows that one range holds about, where before() numbers a table.
RANGE_ROWS = 100_000


def before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum (a long) of its column over the rows before in that total order.

    Ranges of rows are summed apart and then offset, so no task sees more than about RANGE_ROWS rows.
    """
    if (n := -(-df.count() // RANGE_ROWS)) <= 1:
        upto = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c.cast("bigint")).over(upto), F.lit(0)).alias(k) for k, c in sums.items()])
    ranged = df.repartitionByRange(n, *order)
    ranged = cut(ranged.withColumns({f"_n_{k}": c.cast("bigint") for k, c in sums.items()} | {"_range": F.spark_partition_id()}))
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_n_{k}").alias(f"_t_{k}") for k in sums])
    upto = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(upto), F.lit(0)).alias(f"_t_{k}") for k in sums])
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.select("*", *[F.coalesce(F.sum(f"_n_{k}").over(within), F.lit(0)).alias(f"_s_{k}") for k in sums])
    return summed.join(F.broadcast(offsets), "_range").select(*df.columns, *[(F.col(f"_s_{k}") + F.col(f"_t_{k}")).alias(k) for k in sums])


def lean(run: Callable) -> Callable:
    """An Arrow function that gives back what memory its batch has taken: workers live on, and Arrow's pool would keep it."""

    @functools.wraps(run)
    def leanly(*columns):
        try:
            return run(*columns)
        finally:
            pa.default_memory_pool().release_unused()

    return leanly


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, also where a lambda uses it repeatedly."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _joined(links: pa.RecordBatch | pa.Table) -> dict[int, int]:
    """Each node of some links (u, v), with the least node it is joined to."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    for u, v in zip(links.column(0).to_pylist(), links.column(1).to_pylist()):
        a, b = find(u), find(v)
        if a != b:
            top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top}


def _forest(links: DataFrame) -> DataFrame:
    """Links that join the same nodes, each to the least of those that some links of its task join: one for each node at most of FILE_ROWS links."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars() -> pa.RecordBatch:
            found = {x: r for x, r in _joined(pa.Table.from_batches(held)).items() if x != r}
            return pa.RecordBatch.from_pydict({"u": pa.array(found.values(), pa.int64()), "v": pa.array(found.keys(), pa.int64())})

        for batch in batches:
            held, n = [*held, batch], n + len(batch)
            if n >= FILE_ROWS:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()

    return links.mapInArrow(thin, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (u, v), longs: one row (node, root) per node in a link, root the least node.

    Tasks first thin their links out to a forest, by union-find over FILE_ROWS of them at a time. While
    more are left than a task may take (FILE_ROWS), large-star and small-star contraction alternate: each round links every node's
    larger (then smaller) neighbours to its least neighbour, until the links stop
    changing; then each component is a star around its least node. What fits into one task is
    joined there. A node's neighbours are only ever aggregated (min), never collected. Self links are
    ignored, a null end drops the link, an empty input gives an empty result.
    """
    e = edges.where("u <> v").select(F.least("u", "v").cast("bigint").alias("u"), F.greatest("u", "v").cast("bigint").alias("v"))
    e, seen, now = cut(_forest(e)), None, ()

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            found = _joined(pa.Table.from_batches(held))
            yield pa.RecordBatch.from_pydict({"node": pa.array(found.keys(), pa.int64()), "root": pa.array(found.values(), pa.int64())})

    while now != seen:
        seen, n = now, e.count()
        if n <= FILE_ROWS:
            return cut(e.coalesce(1).mapInArrow(rooted, "node bigint, root bigint"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        star = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: u's smaller neighbours and u itself go to the least of them
        least = star.groupBy("v").agg(F.min("u").alias("m"))
        small = star.join(least, "v").select(F.col("m"), F.explode(F.array("u", "v")).alias("x"))
        new = cut(small.where("m <> x").select(F.col("m").alias("u"), F.col("x").alias("v")).distinct(), n)
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_scratch(e)
        e = new
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
