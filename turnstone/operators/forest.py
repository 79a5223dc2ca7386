"""Records as forests: every subtree a range of numbers, common ancestors of many pairs, and the cycles that are no trees.

Records are those of lineage: source, record_id, parent_id. All work is done in about log2
rounds of the longest tour or cycle; a round is a shuffle join of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnstone.operators.lineage import KEYS, climbed, links_of
from turnstone.plans.scratch import cut, cut_counting, drop_scratch


def _ranked(steps: DataFrame, sums: list[str]) -> DataFrame:
    """Parallel list ranking: of each row (source, node, next, sums) the sums over it and all that follow it; next is null at a list's end.

    Pointer doubling: a row knows the sums up to where it points, and takes over those from there on.
    What never reaches an end, as on a cycle, is left out.
    """
    rows, state, left = steps.count(), steps.select("source", "node", "next", *sums), None
    now = {"open": rows}
    while now["open"] and now["open"] != left:
        left = now["open"]
        on = state.select("source", F.col("node").alias("next"), F.col("next").alias("_next"), *[F.col(c).alias(f"_{c}") for c in sums])
        moved = state.where("next IS NOT NULL").join(on, ["source", "next"]).select("source", "node", F.col("_next").alias("next"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums])
        new, now = cut_counting(state.where("next IS NULL").unionByName(moved), rows, open=F.count("next"))
        drop_scratch(state)
        state = new
    return state.where("next IS NULL").drop("next")


def numbered(records: DataFrame, weight: Column | None = None) -> DataFrame:
    """A row per record that reaches a root: source, record_id, parent_id (null at a root), pre, size, depth and, with weight, total.

    pre: the record's place (from 0) when its source's trees are walked, parents first, then children
    by id; size: the records of its subtree, itself included, which are those whose pre is pre .. pre + size - 1;
    total: the sum of their weights. An orphan is a root. Records on cycles or below one are left out. Of several rows with one id the
    one with the least parent_id counts, and its weight; of equal ones the largest weight.

    An Euler tour enters and leaves each record; ranking it as a list sums up, from each
    place on, what is entered and how deep it is. No record's subtree or path is ever collected. A record's children
    are numbered in one task.
    """
    links = links_of(records, weight)
    null = F.lit(None).cast(links.schema["record_id"].dataType)
    place = lambda c, leaves: F.struct(F.col(c).alias("id"), F.lit(leaves).alias("leaves"))
    up = F.when(F.col("has_parent"), F.col("parent_id")).otherwise(null)
    own = cut(links.select(*KEYS, up.alias("up"), F.coalesce("weight", F.lit(0)).cast("bigint").alias("weight")))
    siblings = own.withColumn("following", F.lead("record_id").over(W.partitionBy("source", "up").orderBy("record_id")))
    first = own.where("up IS NOT NULL").groupBy("source", F.col("up").alias("record_id")).agg(F.min("record_id").alias("child"))
    tour = siblings.join(first, KEYS, "left")
    none = F.lit(None).cast(tour.select(place("record_id", True).alias("p")).schema["p"].dataType)
    enter = F.struct(place("record_id", False).alias("node"), F.when(F.col("child").isNotNull(), place("child", False)).otherwise(place("record_id", True)).alias("next"), F.lit(1).cast("bigint").alias("entered"), F.lit(1).cast("bigint").alias("level"), "weight")
    after = F.when(F.col("following").isNotNull(), place("following", False)).when(F.col("up").isNotNull(), place("up", True)).otherwise(none)
    leave = F.struct(place("record_id", True).alias("node"), after.alias("next"), F.lit(0).cast("bigint").alias("entered"), F.lit(-1).cast("bigint").alias("level"), F.lit(0).cast("bigint").alias("weight"))
    steps = cut(tour.select("source", F.inline(F.array(enter, leave))))
    ranked = _ranked(steps, ["entered", "level", "weight"])
    both = ranked.groupBy("source", F.col("node.id").alias("record_id")).agg(
        *[F.max(F.when(F.col("node.leaves") == leaves, F.col(c))).alias(f"{c}_{n}") for c in ("entered", "level", "weight") for n, leaves in (("in", False), ("out", True))]
    )
    counts = both.groupBy("source").agg(F.count("*").alias("records"))
    found = both.join(counts, "source").join(own.select(*KEYS, F.col("up").alias("parent_id")), KEYS)
    total = [(F.col("weight_in") - F.col("weight_out")).alias("total")] * (weight is not None)
    return found.select(*KEYS, "parent_id", (F.col("records") - F.col("entered_in")).alias("pre"), (F.col("entered_in") - F.col("entered_out")).alias("size"), (-F.col("level_in")).cast("int").alias("depth"), *total)


def taken_away(records: DataFrame, weight: Column) -> DataFrame:
    """What a rewind to before each record discards: n records, its subtree, whose weights sum up to total. All records at once."""
    return numbered(records, weight).select(*KEYS, F.col("size").alias("n"), "total")


def common_ancestors(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (source, a, b) with a column ancestor: the deepest record on both ways to the root, a and b included.

    It is null where they have different roots, or one of them is missing, on a cycle or below one. A
    record's number and depth make this a range minimum: of the records after a up to b, in the order of
    the tour, the parent of the least deep one. Minima of ranges of 2 ** k places are
    tabled once, k up to log2 of the largest source; each pair looks up two of them, so its cost doesn't depend on how
    deep it lies.
    """
    forest = cut(numbered(records))
    least = F.struct("depth", "parent_id")
    level = cut(forest.select("source", F.lit(0).alias("k"), F.col("pre").alias("place"), least.alias("least")))
    most = forest.agg(F.max("pre")).first()[0] or 0
    levels, k = [level], 0
    while 2 << k <= most + 1:
        half = F.lit(1 << k)
        other = level.select("source", (F.col("place") - half).alias("place"), F.col("least").alias("_other"))
        level = cut(level.join(other, ["source", "place"]).select("source", F.lit(k + 1).alias("k"), "place", F.least("least", "_other").alias("least")))
        levels.append(level)
        k += 1
    table = levels[0]
    for more in levels[1:]:
        table = table.unionByName(more)
    of = forest.select("source", F.col("record_id").alias("_id"), "pre")
    asked = pairs.select("source", "a", "b").distinct()
    asked = asked.join(of.select("source", F.col("_id").alias("a"), F.col("pre").alias("_a")), ["source", "a"]).join(of.select("source", F.col("_id").alias("b"), F.col("pre").alias("_b")), ["source", "b"])
    begin, end = F.least("_a", "_b") + 1, F.greatest("_a", "_b")
    spans = asked.where("_a <> _b").select("source", "a", "b", begin.alias("begin"), end.alias("end")).withColumn("k", F.floor(F.log2(F.col("end") - F.col("begin") + 1)).cast("int"))
    looked = spans.select("source", "a", "b", "k", F.explode(F.array("begin", F.expr("end - shiftleft(1L, k) + 1"))).alias("place"))
    found = looked.join(table, ["source", "k", "place"]).groupBy("source", "a", "b").agg(F.min("least").getField("parent_id").alias("ancestor"))
    same = asked.where("_a = _b").select("source", "a", "b", F.col("a").alias("ancestor"))
    return pairs.join(found.unionByName(same), ["source", "a", "b"], "left")


def cycles(records: DataFrame) -> DataFrame:
    """A row per record on a cycle: source, cycle (its least record_id), length, position and record_id.

    Position 0 has the least id, 1 its parent, and so on round the cycle. What hangs below a cycle isn't on it: a walk of as
    many steps as there are records ends on cycles alone, and reaches all of each. Walks double, as do
    the least ids that they have seen.
    """
    links = links_of(records)
    state, _ = climbed(links)
    knotted = cut(state.where("NOT done").select(*KEYS).join(links.select(*KEYS, "parent_id"), KEYS))

    def doubled(rows: DataFrame, least: bool) -> DataFrame:
        """Each row's end (and least id) after as many steps of parent_id as its source has rows, or up to twice as many."""
        n = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        walk = cut(rows.select(*KEYS, F.col("parent_id").alias("at"), F.least("record_id", "parent_id").alias("least")))
        steps = 1
        while steps < n:
            on = walk.select("source", F.col("record_id").alias("at"), F.col("at").alias("_at"), F.col("least").alias("_least"))
            new = cut(walk.join(on, ["source", "at"]).select(*KEYS, F.col("_at").alias("at"), (F.least("least", "_least") if least else F.col("least")).alias("least")))
            drop_scratch(walk)
            walk, steps = new, 2 * steps
        return walk

    ends = doubled(knotted, False).select("source", F.col("at").alias("record_id")).distinct()
    rounds = cut(knotted.join(ends, KEYS, "left_semi"))
    named = cut(doubled(rounds, True).select(*KEYS, F.col("least").alias("cycle")).join(rounds, KEYS))
    opened = named.select(*KEYS, "parent_id", (F.col("record_id") != F.col("cycle")).alias("has_parent"), F.lit(False).alias("is_orphan"))
    steps, _ = climbed(cut(opened))
    told = named.join(steps.select(*KEYS, "depth"), KEYS)
    lengths = told.groupBy("source", "cycle").agg(F.count("*").alias("length"))
    return told.join(lengths, ["source", "cycle"]).select("source", "cycle", "length", F.pmod(F.col("length") - F.col("depth"), F.col("length")).alias("position"), "record_id")
