"""Chains of records: parents, branches, cycles, and what a rewind keeps and discards.

A table of records has the columns source, record_id and parent_id (null at a root);
ids are taken within their source. Deep chains are resolved by pointer doubling: each
round joins every open record with what its present ancestor has found, so the
rounds are about log2 of the longest chain's length, cycles or not. Paths are built
only where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnstone.plans.scratch import cut, cut_counting, drop_scratch

KEYS = ["source", "record_id"]


def with_parent(records: DataFrame) -> DataFrame:
    """Each record with whether its parent is there: the columns has_parent and is_orphan."""
    ids = records.select(F.col("source").alias("_source"), F.col("record_id").alias("_id")).distinct()
    joined = records.join(ids, (F.col("source") == F.col("_source")) & (F.col("parent_id") == F.col("_id")), "left")
    found = F.col("_id").isNotNull()
    kept = [F.col(f"`{c}`") for c in records.columns if c not in ("has_parent", "is_orphan")]
    return joined.select(*kept, found.alias("has_parent"), (F.col("parent_id").isNotNull() & ~found).alias("is_orphan"))


def leaves(records: DataFrame) -> DataFrame:
    """Records that are no record's parent."""
    return records.join(records.select("source", F.col("parent_id").alias("record_id")), KEYS, "left_anti")


def orphans(records: DataFrame) -> DataFrame:
    """Records whose parent is named but missing."""
    named = records.where("parent_id IS NOT NULL")
    return named.join(records.select("source", F.col("record_id").alias("parent_id")), ["source", "parent_id"], "left_anti").select(*records.columns)


def forks(records: DataFrame) -> DataFrame:
    """Records with more than one child, and how many they have."""
    children = records.where("parent_id IS NOT NULL").groupBy("source", F.col("parent_id").alias("record_id")).agg(F.count("*").alias("children"))
    return children.where("children > 1")


def links_of(records: DataFrame, weight: Column | None = None) -> DataFrame:
    """A row per record, with has_parent, is_orphan and weight; of several rows with one id the one with the least parent_id (null first), then the largest weight."""
    least = F.min(F.struct(F.col("parent_id").isNotNull().alias("some"), "parent_id", (-(F.lit(0) if weight is None else weight).cast("bigint")).alias("less")))
    one = records.groupBy(*KEYS).agg(least.alias("_l")).select(*KEYS, F.col("_l.parent_id").alias("parent_id"), (-F.col("_l.less")).alias("weight"))
    return cut(with_parent(one))


def climbed(links: DataFrame, ends: DataFrame | None = None, paths: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """A row (source, record_id, at, depth, done) per record of links_of(): the root it reaches and how far that is.

    Those not done are on a cycle or below one. With paths, a column path from below the
    root to the record. With ends (rows source, record_id), also a table (source, end,
    record_id, up) of the records above each end, itself included, up steps above it:
    those up to 2 ** k steps away have the next ones 2 ** k steps above them.
    """
    rows, kind = links.count(), links.schema["record_id"].dataType.simpleString()
    own = [F.when(F.col("has_parent"), F.array("record_id")).otherwise(F.array().cast(f"array<{kind}>")).alias("path")] * paths
    start = links.select(*KEYS, F.when(F.col("has_parent"), F.col("parent_id")).otherwise(F.col("record_id")).alias("at"), F.col("has_parent").cast("int").alias("depth"), *own, (~F.col("has_parent")).alias("done"))
    state, now = cut_counting(start, rows, open=F.count_if(~F.col("done")))
    above = None if ends is None else ends.join(links.select(*KEYS), KEYS, "left_semi").select("source", F.col("record_id").alias("end"), "record_id", F.lit(0).alias("up")).distinct()

    def reached(above: DataFrame) -> DataFrame:
        steps = state.select(*KEYS, F.col("at").alias("_at"), F.col("depth").alias("_more")).where("_more > 0")
        further = above.join(steps, KEYS).select("source", "end", F.col("_at").alias("record_id"), (F.col("up") + F.col("_more")).alias("up"))
        return cut(above.unionByName(further).distinct())

    left = None
    # after k rounds all records less than 2 ** k deep are done; a round that ends none leaves only cycles
    while now["open"] and now["open"] != left:
        left = now["open"]
        if above is not None:
            above = reached(above)
        upper = state.select("source", F.col("record_id").alias("at"), F.col("at").alias("_up"), F.col("depth").alias("_more"), F.col("done").alias("_ends"), *[F.col("path").alias("_between")] * paths)
        whole = [F.concat("_between", "path").alias("path")] * paths
        moved = state.where("NOT done").join(upper, ["source", "at"]).select(*KEYS, F.col("_up").alias("at"), (F.col("depth") + F.col("_more")).alias("depth"), *whole, F.col("_ends").alias("done"))
        new, now = cut_counting(state.where("done").unionByName(moved), rows, open=F.count_if(~F.col("done")))
        drop_scratch(state)
        state = new
    return state, None if above is None else reached(above)


def lineage(records: DataFrame, paths: bool = True) -> DataFrame:
    """A row per record: root_id, depth, path (root to record; only with paths), is_leaf, is_orphan, is_cyclic.

    An orphan is a root of its own. A record that is on a cycle, or below one,
    has no root, depth or path and is_cyclic set; nothing is left out. Of several rows
    with one id the one with the least parent_id (null first) counts. Paths are as long as
    their chains; without them, a row is narrow however deep it is.
    """
    links = links_of(records)
    state, _ = climbed(links, paths=paths)
    has_child = links.where("has_parent").select("source", F.col("parent_id").alias("record_id")).distinct().withColumn("_child", F.lit(True))
    rows = state.join(links.select(*KEYS, "is_orphan"), KEYS).join(has_child, KEYS, "left")
    done = F.col("done")
    return rows.select(
        *KEYS,
        F.when(done, F.col("at")).alias("root_id"),
        F.when(done, F.col("depth")).alias("depth"),
        *[F.when(done, F.concat(F.array("at"), "path")).alias("path")] * paths,
        F.col("_child").isNull().alias("is_leaf"),
        "is_orphan",
        (~done).alias("is_cyclic"),
    )


def active_leaf(records: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Each source's leaf that comes last in the order of some columns of its record, such as a timestamp and a line number.

    Without an order, and between equal ones, the highest id counts; ids that are texts
    compare as such (r9 after r10), so give an order for them.
    """
    last = F.max_by("record_id", F.struct(*(order or []), "record_id"))
    return leaves(records).groupBy("source").agg(last.alias("record_id"))


def branches(records: DataFrame, ends: DataFrame) -> DataFrame:
    """The records on the paths to the given ends (rows source, record_id): rows (source, end, position from the root, record_id).

    An end on a cycle, or below one, has no path; one that is no record is ignored.
    """
    state, above = climbed(links_of(records), ends.select(*KEYS))
    depth = state.where("done").select("source", F.col("record_id").alias("end"), "depth")
    return above.join(depth, ["source", "end"]).select("source", "end", (F.col("depth") - F.col("up")).alias("position"), "record_id")


def branch(records: DataFrame, ends: DataFrame) -> DataFrame:
    """branches() where each source has one end: rows (source, position, record_id)."""
    return branches(records, ends).drop("end")


def abandoned(records: DataFrame, active: DataFrame) -> DataFrame:
    """Records that are on no active branch."""
    return records.select(*KEYS).exceptAll(active.select(*KEYS))


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records that are on both branches."""
    return a.select(*KEYS).intersect(b.select(*KEYS))


def common_ancestor(a: DataFrame, b: DataFrame) -> DataFrame:
    """The deepest record that is on both branches, by source."""
    both = a.join(b.select(*KEYS), KEYS, "left_semi")
    return both.groupBy("source").agg(F.max_by("record_id", "position").alias("record_id"))


def _with_cut(turns: DataFrame, cuts: DataFrame) -> DataFrame:
    ends = cuts.select(F.col("conv_id").alias("_conv"), F.col("cut").alias("_cut"))
    return turns.join(ends, F.col("conv_id") == F.col("_conv"), "left")


def cut_before(turns: DataFrame, cuts: DataFrame) -> DataFrame:
    """One reading of a rewind: of each conversation, the turns before its cut (rows conv_id, cut).

    A conversation without a cut is kept whole.
    """
    return _with_cut(turns, cuts).where("_cut IS NULL OR turn < _cut").drop("_conv", "_cut")


def what_if(turns: DataFrame, cuts: DataFrame) -> DataFrame:
    """Each turn with what a rewind to the cuts does to it: kept or discarded."""
    gone = F.col("_cut").isNotNull() & (F.col("turn") >= F.col("_cut"))
    return _with_cut(turns, cuts).select("conv_id", "turn", F.when(gone, "discarded").otherwise("kept").alias("effect"))


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two versions of conversations, turn by turn: added, removed, changed or same."""
    mine = old.select("conv_id", "turn", F.struct("role", "text").alias("a"))
    theirs = new.select("conv_id", "turn", F.struct("role", "text").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return mine.join(theirs, ["conv_id", "turn"], "full_outer").select("conv_id", "turn", change.alias("change"))


def cost_at(turns: DataFrame) -> DataFrame:
    """At each user turn, what a rewind to it keeps: the turns before it and their characters."""
    before = W.partitionBy("conv_id").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    counted = turns.select("conv_id", "turn", "role", F.count("*").over(before).alias("kept_turns"), F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("kept_chars"))
    return counted.where("role = 'user'").drop("role")
