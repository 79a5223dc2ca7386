"""Pages anywhere in an order, without bringing what stands before them into one task."""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.plans.scratch import cut

#: Rows that one range holds about.
RANGE_ROWS = 100_000


def page(rows: DataFrame, order: list[str], offset: int, n: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows offset .. offset + n - 1 in the order of some columns (nulls first); n is what a reader looks at.

    The columns of the order alone are dealt into ranges, which are counted; sums of the counts say in which
    ranges the page lies. Only rows within those ranges' bounds are then sorted, so a page in the
    middle costs what one at the start does. Equal rows in the order come in any order; if more of them than
    a range's are equal, they are one range. Beyond the end there are no rows.
    """
    kept = rows.select(*[F.col(f"`{c}`") for c in rows.columns])
    first = rows.limit(0)
    keys = rows.select(F.struct(*order).alias("key"))
    total = keys.count()
    if offset >= total or n <= 0:
        return first
    ranged = keys.repartitionByRange(-(-total // range_rows), "key").select("key", F.spark_partition_id().alias("range"))
    counted = cut(ranged.groupBy("range").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")))
    counts = sorted((r["range"], r["n"]) for r in counted.select("range", "n").collect())  # a row for each range
    upto = list(itertools.accumulate(c for _, c in counts))
    begin, end = (bisect.bisect_right(upto, x) for x in (offset, min(offset + n, total) - 1))
    bounds = counted.where(F.col("range").between(counts[begin][0], counts[end][0])).agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
    key = F.struct(*order)
    near = kept.join(F.broadcast(bounds), (key >= F.col("_low")) & (key <= F.col("_high"))).drop("_low", "_high")
    return near.orderBy(*order).offset(offset - (upto[begin - 1] if begin else 0)).limit(n)
