"""Exact top-k search by inner product: a KD-tree for each shard, searched best box first."""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_counted

#: Vectors of a shard, queries that meet a shard in one task, and boxes that meet a block of queries.
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
BLOCK_BOXES = 4096
#: The shards' regions are fitted on so many vectors at most (those of least hash); every row is put into one.
FIT_ROWS = 8192
LEAF = 128
#: Sums of products under this are exact in double precision.
EXACT = 2**53
#: Scores saturate here, on both sides.
MOST = 2**63 - 1


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each value, as doubles (which hold it exactly up to 2**53)."""
    with np.errstate(over="ignore"):
        return np.floor(values * scale)


def exact(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each value as Python ints, whatever their size. scale is a power of two."""
    return np.array([int(np.floor(x * scale)) if abs(x) < EXACT else int(x) * int(scale) for x in values.ravel().tolist()], dtype=object).reshape(values.shape)


def small(values: np.ndarray, scale: float) -> np.ndarray:
    """Of each row, whether inner products with other such rows are exact in doubles."""
    return (np.abs(values).max(axis=1, initial=0.0) * scale + 1) ** 2 * max(1, values.shape[1]) < EXACT


class KDTree:
    """Median splits of vectors along the widest side, with tight bounding boxes.

    Nodes are stored in preorder; a leaf covers rows begin .. end - 1. Equal vectors are
    split by position, so copies don't deepen the tree. vectors are doubles or Python ints.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        self.low, self.high, self.begin, self.end, self.right = [], [], [], [], []
        self._split(vectors, order, 0, len(order), leaf)
        self.vectors, self.ids = vectors[order], ids[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _split(self, vectors, order, begin, end, leaf) -> int:
        node, own = len(self.begin), vectors[order[begin:end]]
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.begin.append(begin)
        self.end.append(end)
        self.right.append(0)
        if end - begin > leaf and vectors.shape[1]:
            side, half = int((self.high[node] - self.low[node]).argmax()), (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(own[:, side], half, kind="introselect")]
            self._split(vectors, order, begin, begin + half, leaf)
            self.right[node] = self._split(vectors, order, begin + half, end, leaf)
        return node

    def exactly(self) -> KDTree:
        """The same tree over Python ints."""
        found = object.__new__(KDTree)
        found.__dict__ = self.__dict__ | {k: _ints(self.__dict__[k]) for k in ("low", "high", "vectors")}
        return found

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """bounds[q, node]: the most that a vector in the node's box can score."""
        return bounds(queries, self.low, self.high)

    def search(self, query: np.ndarray, bounds: np.ndarray, k: int, kth: float) -> tuple[list[tuple[int, int, int]], float]:
        """The best (score, -id, row) that may be in the overall k best, and the new kth score.

        kth: a score that k candidates are known to reach; boxes that can't are left out.
        Boxes are opened in the order of their bounds, so the search ends at the first one
        under the kth score.
        """
        best: list[tuple[int, int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= kth:
            _, node = heapq.heappop(heap)
            if right := self.right[node]:
                for child in (node + 1, right):
                    if bounds[child] >= kth:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            begin, end = self.begin[node], self.end[node]
            scores = saturated(self.vectors[begin:end] @ query)
            for i in np.flatnonzero(scores >= kth):
                entry = (int(scores[i]), -int(self.ids[begin + i]), int(begin + i))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return best, kth


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most that each query can score in each box."""
    return saturated(np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T)


def saturated(scores: np.ndarray) -> np.ndarray:
    """Scores that are Python ints, brought into the range of a long; doubles are within it."""
    return np.clip(scores, -MOST, MOST) if scores.dtype == object else scores


def _ints(values: np.ndarray) -> np.ndarray:
    return values if values.dtype == object else np.array([int(x) for x in values.ravel().tolist()], dtype=object).reshape(values.shape)


def _rows(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


class Regions:
    """Median splits over a sample of vectors of one length: the top of a KD-tree, which says whose shards a vector belongs to."""

    def __init__(self, vectors: np.ndarray, parts: int):
        self.side, self.at, self.child = [], [], []
        self._split(vectors, parts)

    def _split(self, own: np.ndarray, parts: int) -> int:
        node = len(self.side)
        spread = own.max(axis=0, initial=-np.inf) - own.min(axis=0, initial=np.inf) if own.size else np.zeros(0)
        inner = parts > 1 and len(own) > 1 and spread.size > 0 and spread.max() > 0
        side = int(spread.argmax()) if inner else 0
        at = float(np.median(own[:, side])) if inner else 0.0
        left = own[:, side] < at if inner else None
        if inner and not left.any():
            inner = False
        self.side.append(side)
        self.at.append(at)
        self.child.append((-1, -1))
        if inner:
            self.child[node] = (self._split(own[left], parts // 2), self._split(own[~left], parts - parts // 2))
        return node

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The number of each vector's region."""
        at, side, child = np.zeros(len(vectors), dtype=np.int64), np.array(self.side), np.array(self.child)
        split = np.array(self.at)
        while True:
            open_ = np.flatnonzero(child[at, 0] >= 0)
            if not len(open_):
                return at
            node = at[open_]
            at[open_] = child[node, (vectors[open_, side[node]] >= split[node]).astype(int)]


def _region(regions: dict[int, Regions], scale: float, v: Column, dim: Column) -> Column:
    """The region of a vector of doubles; -1 for one whose products doubles don't hold."""

    @F.arrow_udf("bigint")
    def run(vectors: pa.Array, dims: pa.Array) -> pa.Array:
        dims, out = np.array(dims), np.zeros(len(dims), dtype=np.int64)
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            own = np.array(vectors.take(pa.array(at)).flatten(), dtype=float).reshape(len(at), d)
            if d in regions:
                out[at] = regions[d].of(own)
            out[at[~small(own, scale)]] = -1
        return pa.array(out)

    return run(v, dim)


def _trees(placed: DataFrame, scale: float) -> DataFrame:
    """A row (dim, shard, low, high, exact, tree) for each shard: its tree, built once, and its box."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = _rows(rows["v"])
        wide = not small(values, scale).all()
        tree = KDTree(exact(values, scale) if wide else whole(values, scale), rows["id"].to_numpy(np.int64))
        box = [x[0].astype(float).tolist() if not wide else [] for x in (tree.low, tree.high)]
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "low": [box[0]], "high": [box[1]], "exact": [wide], "tree": [pickle.dumps(tree)]})

    return placed.groupBy("dim", "shard").applyInPandas(build, "dim int, shard bigint, low array<double>, high array<double>, exact boolean, tree binary")


#: A block of queries: those of one home shard that are looked for together.
BLOCK = ["dim", "home", "block"]


def _blocks(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queries (q, v, dim, home) with their blocks, BLOCK_QUERIES of one home shard or about as many; and a row (dim, home, block, queries) for each block: its queries by q, and their vectors."""
    sizes = cut(asked.groupBy("dim", "home").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("bigint").alias("blocks")))
    dealt = join_counted(asked, sizes, ["dim", "home"], "inner").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks"))).drop("blocks")

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("q")
        return pd.DataFrame({"dim": [key[0]], "home": [key[1]], "block": [key[2]], "queries": [pickle.dumps((rows["q"].to_numpy(np.int64), _rows(rows["v"])))]})

    return dealt, cut(dealt.groupBy(*BLOCK).applyInPandas(pack, "dim int, home bigint, block bigint, queries binary"))


def _searched(trees: DataFrame, blocks: DataFrame, pairs: DataFrame, k: int, scale: float) -> DataFrame:
    """Rows (dim, home, block, q, vec_id, score, same): of each shard, its queries' best.

    pairs: a row (dim, shard, home, block, picks) for each block that meets a shard, picks being a bit for each
    of the block's queries that do. blocks: with kth, an array of the score that each query's k candidates are known to
    reach (null: none). Each pair is a task's work. same: the vector found is the query's own (or one just like it).
    """
    keys = ["dim", "shard", "home", "block"]
    left = pairs.join(trees.select("dim", "shard", "tree"), ["dim", "shard"]).select(*keys, "picks", "tree").toDF(*keys, "picks", "tree")
    right = pairs.drop("picks").join(blocks, BLOCK).select(*keys, "queries", "kth").toDF(*keys, "queries", "kth")

    def cell(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            tree, (asks, values) = pickle.loads(left["tree"].iloc[0]), pickle.loads(right["queries"].iloc[0])
            kths = [-MOST - 1] * len(asks) if right["kth"].iloc[0] is None else [-MOST - 1 if pd.isna(x) else int(x) for x in right["kth"].iloc[0]]
            picked = np.ones(len(asks), dtype=bool) if left["picks"].iloc[0] is None else np.unpackbits(np.frombuffer(left["picks"].iloc[0], np.uint8), count=len(asks)).astype(bool)
            wide = ~small(values, scale) | (tree.vectors.dtype == object)
            for these, tree_, turn in ((picked & ~wide, tree, whole), (picked & wide, tree.exactly() if wide.any() else None, exact)):
                at = np.flatnonzero(these)
                if not len(at):
                    continue
                questions = turn(values[at], scale)
                for i, query, bound in zip(at.tolist(), questions, tree_.bounds(questions)):
                    rows += [(int(asks[i]), -n, s, bool((tree_.vectors[row] == query).all())) for s, n, row in tree_.search(query, bound, k, kths[i])[0]]
        found = pd.DataFrame(rows, columns=["q", "vec_id", "score", "same"]).astype({"q": "int64", "vec_id": "int64", "score": "int64", "same": "bool"})
        return found.assign(dim=np.int32(key[0]), home=np.int64(key[2]), block=np.int64(key[3]))[[*BLOCK, "q", "vec_id", "score", "same"]]

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "dim int, home bigint, block bigint, q bigint, vec_id bigint, score bigint, same boolean")


def _reached(boxes: DataFrame, blocks: DataFrame, scale: float) -> DataFrame:
    """The pairs of _searched() for the shards, a block's own aside, whose box may hold a score of some query's kth or more.

    Blocks of boxes meet blocks of queries, so there is a row for a block and a shard, never one for a query
    and a shard; boxes of vectors beyond doubles are always reached.
    """
    m = -(-boxes.count() // BLOCK_BOXES) or 1
    grouped = boxes.withColumn("b", F.pmod(F.xxhash64("shard"), F.lit(m)).cast("bigint"))
    cells = cut(grouped.select("dim", "b").distinct().join(blocks.select(*BLOCK), "dim"))
    box = grouped.join(cells, ["dim", "b"]).select("shard", "low", "high", "exact", "b", *BLOCK).toDF("shard", "low", "high", "exact", "b", *BLOCK)
    ask = cells.join(blocks, BLOCK).select("b", *BLOCK, "queries", "kth").toDF("b", *BLOCK, "queries", "kth")

    def cell(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"dim": [], "shard": [], "home": [], "block": [], "picks": []}
        if len(left) and len(right):
            asks, values = pickle.loads(right["queries"].iloc[0])
            kth = np.array([-np.inf if pd.isna(x) else float(x) for x in right["kth"].iloc[0]])
            reach, fine, plain = np.ones((len(asks), len(left)), dtype=bool), np.flatnonzero(small(values, scale)), np.flatnonzero(~left["exact"].to_numpy(bool))
            if len(fine) and len(plain):
                low, high = (_rows(left[c].iloc[plain]) for c in ("low", "high"))
                reach[np.ix_(fine, plain)] = bounds(whole(values[fine], scale), low, high) >= kth[fine][:, None]
            for j in np.flatnonzero(reach.any(axis=0)).tolist():
                if (shard := int(left["shard"].iloc[j])) != key[2]:
                    for name, value in zip(out, (key[0], shard, key[2], key[3], np.packbits(reach[:, j]).tobytes())):
                        out[name].append(value)
        return pd.DataFrame(out).astype({"dim": "int32", "shard": "int64", "home": "int64", "block": "int64"})

    keys = ["dim", "b", "home", "block"]
    return cut(box.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(cell, "dim int, shard bigint, home bigint, block bigint, picks binary"))


def top_k(table: DataFrame, every: int, k: int, scale: float = 256.0, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row (query_id, rank, vec_id, score) for the k best candidates of each query, exactly.

    A component x counts as floor(scale * x); scale is a power of two. Queries: rows whose
    id is divisible by `every`; candidates: all rows but the query's own; ties go to the
    smaller id. Vectors that are null, or hold null or non-finite components, and rows
    with null ids take no part. Vectors of different lengths aren't compared. A repeated row
    is a candidate each time, and each row with a query's id asks, also where it isn't
    the only one. Scores beyond a long saturate at 2 ** 63 - 1 on either side, and those
    that do are ties. An empty table gives no rows; other columns are ignored.

    Equal vectors are folded to the k + 1 rows of least id, which hold all that can be among
    the best, and ask once. Vectors are put into regions by median splits, fitted on at most
    FIT_ROWS of them, and a large region into several shards by hash; every shard has one
    KD-tree. Each query is first searched in its own shard; its kth score there then
    rules out shards by their boxes, before anything is sent there, and bounds the search
    of the others. Each shard and block of queries is a task's work; vectors of queries are sent by block.
    """
    x = F.transform(vector_col, lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    # -0.0 and 0.0 are one vector: adding 0.0 leaves only the latter
    valid = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite).select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda e: e + 0.0).alias("v"))
    rows = cut(valid.select("id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("h")))
    least = W.partitionBy("h", "v").orderBy("id")
    some = rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).drop("n")
    some = cut(some)
    parts = -(-some.count() // shard_rows) or 1
    # one shard's vectors need no regions to be told apart by
    sample = some.orderBy("h", "id").limit(FIT_ROWS).select("dim", "v").toPandas() if parts > 1 else pd.DataFrame({"dim": [], "v": []})
    regions = {int(d): Regions(_rows(own), parts) for d, own in sample.groupby("dim")["v"]}
    known = some.withColumn("region", _region(regions, scale, F.col("v"), F.col("dim")))
    if parts > 1:
        known = cut(known)
        sizes = cut(known.groupBy("dim", "region").agg(F.ceil(F.count("*") / shard_rows).cast("bigint").alias("subs")))

    def shard(df: DataFrame) -> DataFrame:
        if parts == 1:
            return df.withColumn("shard", F.shiftleft("region", 40)).drop("region")
        sub = F.pmod(F.xxhash64("h"), F.col("subs"))
        return join_counted(df, sizes, ["dim", "region"], "inner").withColumn("shard", F.shiftleft("region", 40) + sub).drop("subs", "region")

    trees = cut(_trees(shard(known), scale))
    queries = rows.where(F.col("id") % every == 0)
    asked = queries.select("h", "v", "dim").distinct().withColumn("region", _region(regions, scale, F.col("v"), F.col("dim")))
    asked = cut(shard(asked).withColumnRenamed("shard", "home").withColumn("q", F.monotonically_increasing_id()))
    (dealt, blocks), none = _blocks(asked), F.lit(None)

    def best(found: DataFrame) -> DataFrame:
        order = W.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")

    home = blocks.select("dim", F.col("home").alias("shard"), "home", "block", none.cast("binary").alias("picks"))
    found = cut(_searched(trees, blocks.withColumn("kth", none.cast("array<bigint>")), home, k + 1, scale))
    if parts > 1 or trees.count() > 1:
        # each query's kth score at home, in the order of its block (a query whose shard is empty has none)
        kth = found.groupBy(*BLOCK, "q").agg(F.when(F.count("*") == k + 1, F.min("score")).alias("kth"))
        of = dealt.select(*BLOCK, "q").join(kth, [*BLOCK, "q"], "left")
        kths = of.groupBy(*BLOCK).agg(F.transform(F.sort_array(F.collect_list(F.struct("q", "kth"))), lambda x: x["kth"]).alias("kth"))
        bounded = cut(blocks.join(kths, BLOCK))
        others = _searched(trees, bounded, _reached(trees.drop("tree"), bounded, scale), k + 1, scale)
        found = best(found.unionByName(others))
    # of k + 1 candidates the query's own row goes, if it is among them, else the last
    entry = F.struct((-F.col("score")).alias("against"), "vec_id", "same")
    told = cut(found.groupBy("q").agg(F.sort_array(F.collect_list(entry)).alias("found")))
    answers = join_counted(queries.select("id", "h", "v"), cut(asked.select("h", "v", "q").join(told, "q")), ["h", "v"], "inner")
    own = F.array_position(F.transform("found", lambda e: (e["vec_id"] == F.col("id")) & e["same"]), True)
    kept = answers.select("id", "found", own.alias("own")).select("id", F.slice(F.filter("found", lambda e, i: i + 1 != F.col("own")), 1, k).alias("found"))
    out = kept.select(F.col("id").alias("query_id"), F.posexplode("found").alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias(id_col), (-F.col("e.against")).alias("score"))
