"""Mixing sources to target weights, by blocks of words drawn through index permutations."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, before, cut, join_counted, lean

#: Slots that one task row unfolds, and those that one task does about.
RUN = 8192
TASK_SLOTS = 1 << 18
#: Sources whose slots are dealt out to the shards together, in one task.
GROUP = 4096


def planned(sizes: DataFrame, block: int, most: int = 3) -> DataFrame:
    """Targets and slots of sources: sizes is a table (source, size, docs), a row for each source.

    Sources rank by code point, null last, and weigh 1, 2, 3, 1, ... The sum of sizes is
    shared by weight; what a share has above most * size is shared again. That ends with
    the level L at which min(weight * L, most * size) sum up to the total: sources are
    capped in the order of most * size / weight, and prefix sums in that order tell where
    that ends. A source is laid out in blocks of equal length (one word more or less), at
    most `block` words each, and gets slots = target / (size / blocks) blocks, of the last of
    which it takes `share` (0: whole). No block is drawn oftener than `most` times.
    """
    sized = cut(sizes)
    total, zero = sized.agg(F.sum("size")).first()[0] or 0, F.lit(0).cast("bigint")
    ranked = before(sized, [F.col("source").isNull(), F.col("source")], {"rank": F.lit(1)})
    ranked = cut(ranked.withColumn("weight", (1 + F.col("rank") % 3).cast("bigint")).withColumn("most", F.col("size") * most))
    weights = ranked.agg(F.sum("weight")).first()[0] or 0
    ordered = before(ranked, [F.col("most") / F.col("weight"), F.col("rank")], {"spent": F.col("most"), "gone": F.col("weight"), "place": F.lit(1)})
    ordered = cut(ordered.withColumn("left", total - F.col("spent")).withColumn("weigh", weights - F.col("gone")))
    free = ordered.where(F.col("most").cast("double") > F.col("weight") * F.col("left").cast("double") / F.col("weigh")).agg(F.min(F.struct("place", "left", "weigh")).alias("f")).first()["f"]
    share = F.lit(None) if free is None else F.when(F.col("place") >= free["place"], F.col("weight") * float(free["left"]) / float(free["weigh"]))
    blocks = F.ceil(F.col("size") / block).cast("bigint")
    found = ordered.select("rank", F.col("source").alias("name"), F.col("size").alias("source_size"), "docs", F.coalesce(share.cast("double"), F.col("most").cast("double")).alias("target"), blocks.alias("blocks"))
    whole = F.when(F.col("blocks") > 0, F.least(F.col("target") * F.col("blocks") / F.col("source_size"), F.col("blocks") * float(most))).otherwise(0.0)
    return found.withColumns({"slots": F.ceil(whole).cast("bigint"), "share": whole - F.floor(whole), "base": F.when(F.col("blocks") > 0, F.expr("source_size div blocks")).otherwise(zero), "extra": F.when(F.col("blocks") > 0, F.col("source_size") % F.col("blocks")).otherwise(zero), "parts": F.ceil(F.sqrt("docs")).cast("bigint")})


def draw(slots, shards: int, seed: int, wants=None) -> np.ndarray:
    """counts[shard, source]: multinomial draws, each in proportion to the slots still left.

    Where a draw exceeds what a source has left, the excess is drawn again from the
    others; so the shards are random, and together they hold each source's slots. wants: how
    many slots each shard gets (they sum up to all); equal numbers, if none are given.
    """
    rng, left = np.random.default_rng(seed), np.array(slots, dtype=np.int64)
    counts = np.zeros((shards, len(left)), dtype=np.int64)
    for shard in range(shards):
        want = int(left.sum()) // (shards - shard) if wants is None else int(wants[shard])
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            counts[shard] += got
            left -= got
            want -= int(got.sum())
    return counts


def permute(position: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1 for each key, applied to positions.

    A Feistel network over the least even number of bits that holds n, walked on
    while it leads outside.
    """
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    x, out = position.astype(np.uint64), np.ones(len(position), dtype=bool)
    while out.any():
        a, b, h, m, k = x[out] >> half[out], x[out] & low[out], half[out], low[out], key[out].astype(np.uint64)
        for r in range(rounds):
            f = (b + k + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f ^ (f >> np.uint64(32))) & m)
        x[out] = (a << h) | b
        out[out] = x[out] >= n[out].astype(np.uint64)
    return x.astype(np.int64)


class Mix:
    """The plan of a mix of docs, and its tables.

    docs needs the columns id_col, source_col and text_col. Null texts have no words; the
    null source is a source; rows with null ids and repeated rows are documents like
    any other. Documents without words lie in no block. keep: other columns that the
    layout carries.
    """

    def __init__(self, docs: DataFrame, block: int = 64, shards: int = 16, seed: int = 7, most: int = 3, keep: tuple[str, ...] = (), id_col="doc_id", source_col="source", text_col="text"):
        self.shards, self.seed = shards, seed
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
        sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("h"), *keep))
        self.sources = cut(planned(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")), block, most))
        self.n = self.sources.count()
        spec = self.sources.select("rank", "name", "source_size", "target", "blocks", "base", "extra", "parts")
        # each source's documents are laid out in as many parts as a part has documents, so that no source is one task's work
        named = join_counted(sized, spec, F.col("source").eqNullSafe(F.col("name")), "inner", rows=self.n).withColumn("part", F.pmod(F.xxhash64("id", "h"), F.col("parts")))
        upto = W.partitionBy("rank").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        offsets = cut(named.groupBy("rank", "part").agg(F.sum("size").alias("n")).select("rank", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset")))
        within = W.partitionBy("rank", "part").orderBy("id", "size", "h", *keep)
        ends = named.withColumn("end", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)))
        #: A row for each document: its words are start .. start + size - 1 of its source's.
        self.laid = join_counted(ends, offsets, ["rank", "part"], "inner").withColumn("start", F.col("offset") + F.col("end") - F.col("size")).drop("part", "parts", "offset", "end", "name", "source", "h")

    def runs(self) -> DataFrame:
        """A row (rank, shard, first, n, blocks, slots) for each shard's slots of each source: first .. first + n - 1.

        The shards' numbers are drawn for groups of sources, then in each group for its sources.
        """
        groups, shards, seed = -(-self.n // GROUP) or 1, self.shards, self.seed
        dealt = self.sources.where("slots > 0").withColumn("group", F.col("rank") % groups)
        sums = {r["group"]: r["n"] for r in dealt.groupBy("group").agg(F.sum("slots").alias("n")).collect()}
        keys = sorted(sums)
        self.total = sum(sums.values())
        wants = draw([sums[k] for k in keys], shards, seed)
        table = self.sources.sparkSession.createDataFrame([(k, wants[:, i].tolist()) for i, k in enumerate(keys)], "group bigint, wants array<bigint>")

        def deal(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("rank")
            counts = draw(rows["slots"].to_numpy(), shards, seed + 1 + int(rows["group"].iloc[0]), rows["wants"].iloc[0])
            first = np.cumsum(counts, axis=0) - counts
            shard, at = np.nonzero(counts)
            found = rows[["rank", "blocks", "slots"]].iloc[at].reset_index(drop=True)
            return found.assign(shard=shard.astype("int32"), first=first[shard, at], n=counts[shard, at])

        rows = join_counted(dealt.select("group", "rank", "blocks", "slots"), table, "group", "inner", rows=len(keys))
        return rows.groupBy("group").applyInPandas(deal, "rank bigint, blocks bigint, slots bigint, shard int, first bigint, n bigint")

    def slots(self) -> DataFrame:
        """A row (shard, rank, slot, epoch, block, last) for each drawn slot; last: of a source's slots it is the last one."""
        table = cut(self.runs())
        table = table.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {RUN}"))).alias("run"))
        # runs are tiny rows that unfold: their number of tasks is given, as sizes would put them all into one
        table = table.repartition(-(-self.total // TASK_SLOTS) or 1, "rank", "shard", "run")
        last = F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1
        table = table.select("shard", "rank", "blocks", "slots", F.explode(F.sequence(F.col("first") + F.col("run") * RUN, F.col("first") + last)).alias("slot"))
        epoch = F.expr("slot div blocks")
        block = _block(F.col("slot") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(self.seed), "rank", epoch))
        return table.select("shard", "rank", "slot", epoch.alias("epoch"), block.alias("block"), (F.col("slot") == F.col("slots") - 1).alias("last"))

    def drawn(self) -> DataFrame:
        """A row (rank, block, times, part) for each block that was drawn.

        times: how often it was drawn whole; part: the words at its beginning that are taken
        once more, null if none are. The slots grow from a small table, which the planner's sizes
        don't show; the hint keeps it from broadcasting them.
        """
        cut_off = self.sources.where("share > 0").select("rank", (F.col("share") * F.col("source_size") / F.col("blocks")).alias("words"))
        slots = join_counted(self.slots(), cut_off, "rank", rows=self.n)
        partly = F.col("last") & F.col("words").isNotNull()
        return slots.groupBy("rank", "block").agg(F.count_if(~partly).alias("times"), F.max(F.when(partly, F.round("words").cast("bigint"))).alias("part")).hint("merge")

    def pieces(self, *columns: str) -> DataFrame:
        """A row for each block that a document has words in: the block, the words from .. to - 1 of the document there, and the word of the block that is `from`."""
        longer = F.col("extra") * (F.col("base") + 1)  # words in the blocks that have one more

        def block_of(word: Column) -> Column:
            return F.when(word < longer, F.floor(word / (F.col("base") + 1))).otherwise(F.col("extra") + F.floor((word - longer) / F.col("base"))).cast("bigint")

        lies = self.laid.where("size > 0").select("rank", "start", "size", "base", "extra", *columns, F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("start") + F.col("size") - 1))).alias("block"))
        begins, length = F.col("block") * F.col("base") + F.least("block", "extra"), F.col("base") + F.when(F.col("block") < F.col("extra"), 1).otherwise(0)
        begin, end = F.greatest("start", begins), F.least(F.col("start") + F.col("size"), begins + length)
        return lies.select("rank", "block", "start", "size", *columns, (begin - F.col("start")).alias("from"), (end - F.col("start")).alias("to"), (begin - begins).alias("at"))


def _block(position: Column, n: Column, key: Column) -> Column:
    @F.arrow_udf("bigint")
    @lean
    def run(position: pa.Array, n: pa.Array, key: pa.Array) -> pa.Array:
        return pa.array(permute(*(np.array(x, dtype=np.int64) for x in (position, n, key))))

    return run(position, n, key)


def words_taken(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """A row (id, size, source_size, target, taken) for each row of docs: the words that the mix takes of it.

    Draws and permutations depend on the seed and on the sources' sizes alone, so
    reruns agree. Null texts, null ids and sources, and repeated rows are treated as Mix
    says; an empty table gives no rows; other columns are ignored. The words of a very long text are counted in one task; its blocks
    are spread. Identical rows are laid out by one task.
    """
    mix = Mix(docs, id_col=id_col, **options)
    keep = ["id", "source_size", "target"]
    found = mix.pieces(*keep).join(mix.drawn(), ["rank", "block"], "left")
    partly = F.when(F.col("part") > F.col("at"), F.least(F.col("to") - F.col("from"), F.col("part") - F.col("at"))).otherwise(0)
    words = (F.col("to") - F.col("from")) * F.coalesce("times", F.lit(0)) + partly
    taken = found.groupBy("rank", "start", "size", *keep).agg(F.sum(words).cast("bigint").alias("taken")).select(*keep, "size", "taken")
    rest = mix.laid.where("size = 0").select(*keep, "size", F.lit(0).cast("bigint").alias("taken"))
    return taken.unionByName(rest).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


_WORD = re.compile(WORD)


def _cut_words(text: str, size: int, spans: list[tuple[int, int]]) -> list[str]:
    """For each span (start, end) the words start .. end - 1 of a text of so many words, with what stands between them."""
    if any(span != (0, size) for span in spans):
        begins, ends = zip(*(m.span() for m in _WORD.finditer(text)))
    return [text if span == (0, size) else text[begins[span[0]] : ends[span[1] - 1]] for span in spans]


def mixed_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents of the mix, with the columns of docs.

    A document whose blocks are all drawn appears whole, once for each time; of
    another, each run of neighbouring drawn blocks gives a row with just its words.
    length_col (if docs has it) is made the length of the new text. Documents without words
    give no row; repeated rows are documents each; an empty table gives no rows; columns of
    any other name ride along.

    docs is written to the shared folder with a number for each row, and only numbers and
    sizes go through the plan; whole texts meet what is taken of them in one join, last. A
    long document is cut in one pass, however many runs it gives.
    """
    row, names = "_turnstone_row", docs.columns
    docs = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    mix = Mix(docs, keep=(row,), text_col=text_col, **options)
    drawn = mix.pieces(row).join(mix.drawn(), ["rank", "block"])
    # a copy for each time a block was drawn whole, and copy 0 for the beginning of one
    whole = drawn.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).select(row, "size", "copy", "block", "from", "to")
    partly = drawn.where("part > at").select(row, "size", F.lit(0).cast("bigint").alias("copy"), "block", "from", F.least(F.col("to"), F.col("from") + F.col("part") - F.col("at")).alias("to"))
    # the blocks of one document: runs are what a document's length bounds
    order = W.partitionBy(row, "copy").orderBy("block")
    run = whole.unionByName(partly).withColumn("run", F.col("block") - F.row_number().over(order)).groupBy(row, "size", "copy", "run").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    spans = run.groupBy(row, "size").agg(F.sort_array(F.collect_list(F.struct("copy", "from", "to"))).alias("spans"))

    @F.arrow_udf("array<string>")
    @lean
    def words(text: pa.Array, size: pa.Array, spans: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (text, size, spans)))
        return pa.array([_cut_words(t, n, [(x["from"], x["to"]) for x in s]) for t, n, s in rows], pa.list_(pa.string()))

    taken = spans.select(F.col(row).alias(f"{row}_taken"), F.col("size").alias(f"{row}_size"), F.col("spans").alias(f"{row}_spans"))
    joined = docs.join(taken.hint("merge"), F.col(row) == F.col(f"{row}_taken"))
    cut_up = joined.select(*names, F.explode(words(text_col, f"{row}_size", f"{row}_spans")).alias(row))
    replaced = {text_col: F.col(row)} | ({length_col: F.length(row).cast(docs.schema[length_col].dataType)} if length_col in names else {})
    return cut_up.select(*[replaced.get(c, F.col(f"`{c}`")).alias(c) for c in names])
