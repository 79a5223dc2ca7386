"""Centroid clustering (Lloyd's rounds over integer vectors) with ball-tree filtering."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Vectors of a tree, and of one of its leaves.
TREE_ROWS, LEAF = 8192, 64
#: Sums under these are exact in doubles and in longs.
EXACT, LONG = 2**53, 2**62
MOST = 2**63 - 1
#: Components under this have squares, and sums of many squares, that doubles can hold; beyond, bounds can't be told and every vector is measured.
TOLD = 2**490
#: The part of two vectors' squared lengths that rounding can take from, or add to, their squared distance.
SLACK = 1e-12
#: Bits of a sum that travel in one row.
LIMB = 32


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly: as longs, or as Python ints where one would be too large for sums of longs."""
    if np.abs(values).max(initial=0.0) < 2**31 / scale:
        return np.floor(values * scale).astype(np.int64)
    return np.array([math.floor(x * scale) if abs(x) < EXACT else int(x) * scale for x in values.ravel().tolist()], dtype=object).reshape(values.shape)


def distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points (rows) to integer centers: longs, or Python ints."""
    far = max(_farthest(points), _farthest(centers))
    most = 4 * far * far * max(1, points.shape[1])
    if most < EXACT:
        a, b = points.astype(float), centers.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    kind = np.int64 if most < LONG else object
    a, b = points.astype(kind), centers.astype(kind)
    return np.stack([((a - c) ** 2).sum(axis=1) for c in b], axis=1) if len(b) else np.zeros((len(a), 0), kind)


def _farthest(values: np.ndarray) -> int:
    """The largest size of a component."""
    return max(abs(int(values.min())), abs(int(values.max()))) if values.size else 0


class BallTree:
    """Balls around vectors, split at the median of the widest side: of each the center, radius, count and exact sum.

    Balls are numbered so that children follow their parents; a ball covers rows begin .. end - 1.
    """

    def __init__(self, vectors: np.ndarray, ids: list, leaf: int = LEAF):
        order, far = np.arange(len(vectors)), _farthest(vectors)
        self.told = far < TOLD
        spots = vectors.astype(float) if self.told else np.zeros(vectors.shape)  # one ball, if its distances can't be told
        self.begin, self.end, self.children, center, radius = [0], [len(vectors)], [], [], []
        node = 0
        while node < len(self.begin):
            begin, end = self.begin[node], self.end[node]
            own = spots[order[begin:end]]
            center.append(own.mean(axis=0))
            radius.append(math.sqrt(((own - center[-1]) ** 2).sum(axis=1).max(initial=0.0)))
            spread = own.max(axis=0) - own.min(axis=0) if own.shape[1] else np.zeros(1)
            if end - begin > leaf and spread.max() > 0:
                half = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(own[:, int(spread.argmax())], half, kind="introselect")]
                self.children.append((len(self.begin), len(self.begin) + 1))
                self.begin += [begin, begin + half]
                self.end += [begin + half, end]
            else:
                self.children.append(None)
            node += 1
        self.ids, sorted_ = [ids[k] for k in order.tolist()], vectors[order]
        self.center, self.radius = np.array(center), np.array(radius)
        upto = np.concatenate([np.zeros((1, vectors.shape[1]), sorted_.dtype), np.cumsum(sorted_, axis=0)])
        self.sums = upto[self.end] - upto[self.begin]
        self.vectors = sorted_.astype(np.int16) if far < 2**15 else sorted_

    def assigned(self, centroids: np.ndarray) -> Iterator[tuple[int, int | np.ndarray]]:
        """Balls that make up all rows, each with the number of its rows' nearest centroid, or of each row's; of equally near ones the smallest.

        A centroid is left out of a ball if even the ball's nearest point to it is farther away than the farthest
        is from another one. If one centroid is left, it has the whole ball; a leaf's points are
        measured exactly against those left. Where doubles can't hold the squares, all points are.
        """
        if not (self.told and _farthest(centroids) < TOLD):
            yield 0, np.argmin(distances(self.vectors, centroids), axis=1)
            return
        spots = centroids.astype(float)
        size = (self.center**2).sum(1)[:, None] + (spots**2).sum(1)
        squared = np.maximum(size - 2 * (self.center @ spots.T), 0)
        near = np.sqrt(np.maximum(squared - SLACK * size, 0)) - (1 + SLACK) * self.radius[:, None]
        far = np.sqrt(squared + SLACK * size) + (1 + SLACK) * self.radius[:, None]
        open_ = [(0, np.arange(len(centroids)))]
        while open_:
            node, left = open_.pop()
            left = left[near[node, left] <= far[node, left].min()]
            if len(left) == 1:
                yield node, int(left[0])
            elif self.children[node]:
                open_ += [(child, left) for child in self.children[node]]
            else:
                found = distances(self.vectors[self.begin[node] : self.end[node]], centroids[left])
                yield node, left[np.argmin(found, axis=1)]

    def totals(self, centroids: np.ndarray, into: dict[int, list]) -> None:
        """Add to each centroid's [count, sum of its vectors]; whole balls add what they store."""
        for node, who in self.assigned(centroids):
            begin, end = self.begin[node], self.end[node]
            parts = [(who, end - begin, self.sums[node])] if isinstance(who, int) else [(int(c), int((who == c).sum()), self.vectors[begin:end][who == c].sum(axis=0)) for c in np.unique(who)]
            for c, n, total in parts:
                count, old = into.get(c, (0, 0))
                into[c] = [count + n, old + total.astype(object)]

    def labels(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's centroid and its exact squared distance, at most MOST."""
        cluster, distance = np.zeros(len(self.ids), np.int32), np.zeros(len(self.ids), np.int64)
        for node, who in self.assigned(centroids):
            at = slice(self.begin[node], self.end[node])
            cluster[at] = who
        for c in np.unique(cluster):
            own = np.flatnonzero(cluster == c)
            found = distances(self.vectors[own], centroids[c : c + 1])[:, 0]
            distance[own] = np.minimum(found, MOST).astype(np.int64)
        return cluster, distance


def limbs(value: int) -> list[int]:
    """An integer in digits of LIMB bits, the least first; the last one has the sign."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def trees_of(rows: DataFrame, scale: int, tree_rows: int = TREE_ROWS, leaf: int = LEAF) -> DataFrame:
    """A row (tree) for each tree_rows rows (id, v) of a partition: its ball tree. Nothing is shuffled."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0

        def tree() -> pa.RecordBatch:
            made = BallTree(integers(np.concatenate(held), scale), [x for part in ids for x in part], leaf)
            return pa.RecordBatch.from_pydict({"tree": pa.array([pickle.dumps(made)], pa.binary())})

        for batch in batches:
            dims = len(batch.column(1)[0]) if len(batch) else 0
            for k in range(0, len(batch), tree_rows):
                part = batch.slice(k, tree_rows)
                if n + len(part) > tree_rows:
                    yield tree()
                    ids, held, n = [], [], 0
                ids.append(part.column(0).to_pylist())
                held.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims))
                n += len(part)
        if n:
            yield tree()

    return rows.select("id", "v").mapInArrow(build, "tree binary")


def _totals(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Each nearest centroid's count and exact sum. Tasks add up their trees; the driver sees a row for each centroid, dimension and limb."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for blob in batch.column(0):
                pickle.loads(blob.as_py()).totals(centroids, found)
            pa.default_memory_pool().release_unused()
        rows = [(c, d, k, x) for c, (n, total) in found.items() for d, value in [(-1, n), *enumerate(total)] for k, x in enumerate(limbs(int(value)))]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["c", "d", "k", "x"])

    summed = trees.mapInArrow(add, "c int, d int, k int, x bigint").groupBy("c", "d", "k").agg(F.sum("x").alias("x"))
    found: dict[int, dict[int, int]] = {}
    for r in summed.collect():
        own = found.setdefault(r.c, {})
        own[r.d] = own.get(r.d, 0) + (r.x << (LIMB * r.k))
    return {c: (own[-1], [own[d] for d in range(len(own) - 1)]) for c, own in found.items()}


def _array(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(x) < 2**31 for row in rows for x in row)
    return np.array(rows, dtype=np.int64 if small else object)


def usable(v: Column, dims: int) -> Column:
    """Whether a vector has that many components, none of them null or not finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dims) & fine


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", tree_rows: int = TREE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row (id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable vector.

    A component x counts as floor(scale * x), x as a double, scale a power of two. Vectors of another
    length, or with null or non-finite components, are left out. The centroids start as the k
    vectors whose id, in decimal after salt, has the least SHA-256 in hex, of equal ids those of
    least components; rows without an id can't be a start, but are assigned. If there are fewer than k, there are fewer
    clusters; if there is none, no rows come out. Each round assigns every vector to the nearest centroid (of equally near
    ones that of the smallest number) and moves every centroid that has vectors to the floor of their mean; then vectors are assigned once
    more. All this is exact, at any size of components; distances and
    inertias saturate at 2 ** 63 - 1. Repeated rows count each; other columns are ignored.

    Ball trees are built once, within the partitions of the table, and written to the shared folder; each round
    reads them. Only the centroids, and the sums of each, pass through the driver.
    """
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = table.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(usable(F.col("v"), dims))
    trees = cut(trees_of(rows, scale, tree_rows))
    first = rows.where("id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)).orderBy("h", "v").limit(k).collect()
    spark = table.sparkSession
    if not first:
        return spark.createDataFrame([], f"{id_col} bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    now = [[int(x) for x in row] for row in integers(np.array([r.v for r in first], dtype=float).reshape(len(first), dims), scale)]
    for _ in range(rounds):
        for c, (n, total) in _totals(trees, _array(now)).items():
            now[c] = [x // n for x in total]
    last = _array(now)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                tree = pickle.loads(blob.as_py())
                who, distance = tree.labels(last)
                yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64()), pa.array(who), pa.array(distance)], ["id", "cluster", "distance"])
            pa.default_memory_pool().release_unused()

    labelled = cut(trees.mapInArrow(label, "id bigint, cluster int, distance bigint"))
    summed = labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()
    all_ = sum(int(r.own) for r in summed)
    digest = lambda c: hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()
    about = [(r.cluster, min(int(r.own), MOST), min(all_, MOST), digest(r.cluster)) for r in summed]
    known = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return labelled.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
