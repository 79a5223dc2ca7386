"""SimHash near-dedup at a Jaccard similarity of word shingles: pigeonring links, rare shingles, an exact check.

At a similarity of 0.8, 64-bit fingerprints differ in 10 bits, give or take 3. Pigeonring
filtering finds those within 2 bits, which most near copies of one text chain up to; to find all
others by fingerprints alone, segments would be of 4 bits and tell nothing apart. So the
further candidates share a rare shingle, what sizes, positions and parities of shingles leave no room for is
ruled out, and the texts' shingles decide on every other candidate. No similar pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop_scratch, join_counted, lean
from .simhash import distance_of, keep_least, near_links, simhash

#: Words of a shingle.
WIDTH = 5
#: Texts are near-duplicates from a Jaccard similarity of PART / WHOLE.
PART, WHOLE = 4, 5
#: Parities of shingles, in numbers of 64 bits: two sets differ in at least as many shingles as parities.
MARKS = 4
#: Sizes of similar sets lie in one band or in neighbouring ones: bands grow by this factor, which is over WHOLE / PART.
BAND = 2
#: Bits of a group's hash by which rows of different groups are told apart in one go.
DIGIT = 2
#: Counters of shingles, hashed; what is counted often stands last in the order of prefixes.
COUNTERS = 1 << 18
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes (uint64, sorted); words are those of simhash.fingerprint.

    Fewer words than width make one shingle; no word makes none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array(list(map(xxhash.xxh64_intdigest, words)), dtype=np.uint64)
    n = max(1, len(words) - width + 1)
    mixed = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(len(words), width)):
        mixed = (mixed ^ hashes[k : k + n]) * _ODD[0]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[1]
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed * _ODD[2])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles are near-duplicates; two empty ones are."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * shared >= PART * (len(a) + len(b) - shared)


def _key(found: np.ndarray) -> int:
    """A number that is the same just for texts with the same shingles."""
    return xxhash.xxh64_intdigest(found.tobytes()) if len(found) else 0


def _counter(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def marks(found: np.ndarray) -> list[int]:
    """The parity of the number of shingles in each of 64 * MARKS classes."""
    odd = np.bincount((found & np.uint64(64 * MARKS - 1)).astype(np.int64), minlength=64 * MARKS) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _often(docs: DataFrame, text_col: str) -> np.ndarray:
    """How many of all texts' shingles each counter has seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(sums, _counter(shingles(text.as_py())), 1)
            pa.default_memory_pool().release_unused()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"counter": pa.array(at.astype(np.int32)), "n": pa.array(sums[at])})

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    found, often = counts.toArrow(), np.zeros(COUNTERS, dtype=np.int64)
    often[found["counter"].to_numpy()] = found["n"].to_numpy()
    return often


def prefix(found: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of a set in an order that all sets share: of two similar sets, these have one in common at least."""
    order = np.argsort(often[_counter(found)], kind="stable")
    return found[order[: len(found) - -(-PART * len(found) // WHOLE) + 1]].view(np.int64)


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row (id, h, key, fp, size, marks, prefix) for each row of docs; h is the text's hash, key that of its shingles, fp their SimHash."""
    often = _often(docs, text_col)
    kinds = {"key": pa.int64(), "fp": pa.int64(), "size": pa.int64(), "marks": pa.list_(pa.int64()), "prefix": pa.list_(pa.int64())}

    @F.arrow_udf("struct<key: bigint, fp: bigint, size: bigint, marks: array<bigint>, prefix: array<bigint>>")
    @lean
    def run(texts: pa.Array) -> pa.Array:
        key, fp, size, odd, prefixes = [], [], [], [], []
        for t in texts:
            own = shingles(t.as_py())
            key.append(_key(own))
            fp.append(simhash(own))
            size.append(len(own))
            odd.append(marks(own))
            prefixes.append(prefix(own, often))
        columns = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (key, fp)] + [pa.array(size, pa.int64()), pa.array(odd, kinds["marks"]), pa.array(prefixes, kinds["prefix"])]
        return pa.StructArray.from_arrays(columns, names=list(kinds))

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), run(text_col).alias("s")).select("id", "h", "s.*")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of distinct pairs (u, v) of keys, those whose texts (key, text) are similar."""

    @F.arrow_udf("boolean")
    @lean
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similar(shingles(x.as_py()), shingles(y.as_py())) for x, y in zip(a, b)], pa.bool_())

    left, right = (texts.select(F.col("key").alias(k), F.col("text").alias(t)) for k, t in (("u", "a"), ("v", "b")))
    return pairs.join(left, "u").join(right, "v").where(run("a", "b")).select("u", "v")


def _ring_pairs(sets: DataFrame, n: int) -> DataFrame:
    """Pairs (u, v) of sets whose fingerprints pigeonring filtering links, or that have the same one."""
    prints = cut(sets.groupBy("fp").agg(F.min("key").alias("first")), n)
    near = near_links(prints.select("fp"), rows=n)
    linked = join_counted(join_counted(near, prints.toDF("u", "a"), "u", "inner", rows=n), prints.toDF("v", "b"), "v", "inner", rows=n)
    same = join_counted(sets, prints, "fp", "inner", rows=n).where("first <> key")
    return linked.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(same.select(F.col("first").alias("u"), F.col("key").alias("v")))


def _sized(sets: DataFrame) -> DataFrame:
    """Sets as rows of numbers: key, size and the parities p0, p1, ..."""
    return sets.select("key", "size", *[F.get("marks", F.lit(k)).alias(f"p{k}") for k in range(MARKS)])


def _named(who: str, size: str) -> list[str]:
    return [who, size, *[f"{who}{k}" for k in range(MARKS)]]


def _may_be(m: str, n: str) -> Column:
    """Whether the sets u and v can be similar, by their sizes m and n and their parities: similar sets differ in (m + n) / 9 shingles at most."""
    differ = sum(distance_of(F.col(f"u{k}"), F.col(f"v{k}")) for k in range(MARKS))
    return (WHOLE * F.least(m, n) >= PART * F.greatest(m, n)) & ((WHOLE + PART) * differ <= (WHOLE - PART) * (F.col(m) + F.col(n)))


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v, count), the one of each key that counts most: no more pairs than keys."""
    ends = [F.struct(F.col(a).alias("key"), F.struct("count", F.col(b).alias("other")).alias("with")) for a, b in (("u", "v"), ("v", "u"))]
    best = pairs.select(F.inline(F.array(*ends))).groupBy("key").agg(F.max("with").getField("other").alias("other"))
    return best.select(F.least("key", "other").alias("u"), F.greatest("key", "other").alias("v")).distinct()


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Of pairs (u, v), those whose ends aren't of one group; roots: a table from cut() with (key, root), keys without a row being their own."""
    for k in ("u", "v"):
        pairs = join_counted(pairs, roots.toDF(k, f"root_{k}"), k)
    return pairs.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")


def _drop(tables: list[DataFrame]) -> None:
    """Delete tables that cut() returned and that nothing reads any more."""
    for table in tables:
        drop_scratch(table)


def _met(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets of different groups (root) that have a shingle s among their first and may be similar.

    The smaller of two similar sets has one of its first n - 8/9 n shingles in common with
    the other's first, so it is looked up by those alone; sizes are met by bands. Enough has to be left from the common shingle
    on (positional filtering). Two groups are met where their hashes first differ, by a bit that is part of the join's
    key, so rows of one group never meet, however many share s.
    """
    all_, found, turn = WHOLE + PART, [], 0
    is_short = all_ * (F.col("size") - F.col("at")) >= 2 * PART * F.col("size")
    rows = rows.withColumns({"band": F.floor(F.log("size") / math.log(BAND)).cast("int"), "met": F.lit(0).cast("bigint")})
    parities, held = [f"p{k}" for k in range(MARKS)], []
    while True:
        told = rows.groupBy("s", "met").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(is_short).alias("some"))
        parted = cut(told.where("low <> high AND some").select("s", "met"))
        if parted.isEmpty():
            held.append(parted)
            break
        digit = F.shiftrightunsigned(F.xxhash64("root"), turn * DIGIT).bitwiseAND((1 << DIGIT) - 1)
        rows = cut(join_counted(rows, parted, ["s", "met"], "inner").withColumn("digit", digit))
        _drop(held)
        held = [rows, parted]
        # the bits that have agreed so far, and which one is the first that may differ
        below = [F.struct(F.col("met").alias("code"), (F.col("digit").bitwiseAND((1 << k) - 1) * DIGIT + k).cast("int").alias("bit"), F.shiftright("digit", k).bitwiseAND(1).alias("side")) for k in range(DIGIT)]
        short = rows.where(is_short).select("s", "band", "key", "at", "size", *parities, F.inline(F.array(*below)))
        short = short.select("s", "band", "code", "bit", "side", F.col("key").alias("u"), F.col("at").alias("u_at"), F.col("size").alias("m"), *[F.col(p).alias(f"u{k}") for k, p in enumerate(parities)])
        low = F.pow(F.lit(float(BAND)), F.col("near")) * (1 - 1e-9)  # no partner of that band is smaller
        least = F.greatest(low, PART * F.col("size") / WHOLE)
        near = rows.withColumn("near", F.explode(F.array("band", F.col("band") - 1)))
        near = near.where((BAND * low * (1 + 1e-8) > PART * F.col("size") / WHOLE) & (all_ * (F.col("size") - F.col("at")) >= PART * (F.col("size") + least)))
        long = near.select("s", F.col("near").alias("band"), "key", "at", "size", *parities, F.inline(F.array(*below)))
        long = long.select("s", "band", "code", "bit", (1 - F.col("side")).alias("side"), F.col("key").alias("v"), F.col("at").alias("v_at"), F.col("size").alias("n"), *[F.col(p).alias(f"v{k}") for k, p in enumerate(parities)])
        enough = all_ * F.least(F.col("m") - F.col("u_at"), F.col("n") - F.col("v_at")) >= PART * (F.col("m") + F.col("n"))
        order = (F.col("m") < F.col("n")) | (F.col("m") == F.col("n")) & (F.col("u") < F.col("v"))
        pairs = short.join(long, ["s", "band", "code", "bit", "side"]).where(order & enough & _may_be("m", "n"))
        found.append(cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()))
        rows, turn = rows.withColumn("met", F.shiftleft("met", DIGIT).bitwiseOR(F.col("digit"))).drop("digit"), turn + 1
    _drop(held)
    pairs = found[0] if found else rows.select(F.col("key").alias("u"), F.col("key").alias("v")).where("false")
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def links(prefixes: DataFrame, sets: DataFrame, texts_of, spent: DataFrame | None = None) -> DataFrame:
    """Links (u, v) of keys that join the same sets as all similar pairs do.

    prefixes: rows (key, prefix), also several equal ones; sets: each key once, with size,
    fp and marks; texts_of: gives a row (key, text) for each row (key) of a table; spent: a table that cut()
    returned, which is deleted once the prefixes have been read, before texts are moved. Prefix
    filtering: in any order of the shingles that all sets share, two
    similar sets have one of their first n - ceil(0.8 n) + 1 shingles in common. Frequent
    shingles stand last in that order, so those of common lines are seldom among the first.
    Compared first are what pigeonring filtering links, and the sets that have such a shingle
    in common with those two of them in whose order it stands first and last: for each set the likeliest pair, and then
    those whose ends that has not joined; then, where that leaves more than one
    group, pairs of different groups (_met()). So neither a group of near copies nor the texts
    around a passage are paired up. Every link is verified by its texts.
    """
    n = sets.count()
    keyed = prefixes.select(F.posexplode("prefix").alias("at", "s"), "key")
    shared = cut(keyed.groupBy("s").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("s"))
    many = cut(join_counted(keyed, shared, "s", "inner").select("s", "key", "at").distinct())
    if spent is not None:
        _drop([spent])
    # where s stands first, the fewest shingles are a set's own: such a set is the middle of its near copies
    middle = cut(many.groupBy("s").agg(F.min(F.struct("at", "key")).getField("key").alias("lo"), F.max(F.struct("at", "key")).getField("key").alias("hi")))
    of = cut(_sized(sets), n)
    stars = join_counted(many, middle, "s", "inner").select(F.explode(F.array("lo", "hi")).alias("u"), F.col("key").alias("v")).unionByName(_ring_pairs(sets, n))
    stars = stars.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).groupBy("u", "v").count()
    described = join_counted(join_counted(stars, of.toDF(*_named("u", "m")), "u", "inner", rows=n), of.toDF(*_named("v", "n")), "v", "inner", rows=n)
    tried = cut(described.where(_may_be("m", "n")).select("u", "v", "count"))
    _drop([shared, middle])

    def verified(pairs: DataFrame) -> DataFrame:
        texts = cut(texts_of(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()))
        out = cut(_verified(pairs, texts))
        _drop([texts])
        return out

    # most near copies are joined by the pair of theirs that shares most; what that has joined needs no further texts
    likely = cut(_likeliest(tried))
    found = verified(likely)
    roots = cut(components(found).toDF("key", "root"))
    more = cut(_apart(join_counted(tried.select("u", "v"), likely, ["u", "v"], "left_anti"), roots))
    if not more.isEmpty():
        found = found.unionByName(verified(more))
        roots = cut(components(found).toDF("key", "root"))
    rooted = cut(join_counted(many.select("s", "key", "at"), roots, "key").select("s", "key", "at", F.coalesce("root", "key").alias("root")))
    _drop([many])
    parted = cut(rooted.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("s"))
    left = cut(join_counted(join_counted(rooted, parted, "s", "inner"), of, "key", "inner", rows=n))
    _drop([rooted, parted])
    rest = cut(join_counted(_met(left), tried.select("u", "v"), ["u", "v"], "left_anti"))
    _drop([left])
    return found if rest.isEmpty() else found.unionByName(verified(rest))


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row (id, h, root, component_id) for each row of docs; root is the key of a set."""
    described = cut(_described(docs, id_col, text_col))
    rows, prefixes = cut(described.select("id", "h", "key")), described.select("key", "prefix")
    sets = cut(described.groupBy("key").agg(F.min("id").alias("least"), F.min(F.struct("id", "h")).alias("row"), F.any_value("fp").alias("fp"), F.any_value("size").alias("size"), F.any_value("marks").alias("marks")))

    def texts_of(keys: DataFrame) -> DataFrame:  # by id and text hash, which spreads copies out
        wanted = cut(sets.join(keys, "key").select("key", F.col("row.id").alias("of"), F.col("row.h").alias("own")))
        mine = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
        found = join_counted(mine, wanted, (F.col("h") == F.col("own")) & F.col("id").eqNullSafe(F.col("of")), "inner")
        return found.groupBy("key").agg(F.min("text").alias("text"))

    found = cut(links(prefixes, sets, texts_of, described))
    roots = cut(components(found).toDF("key", "root"))
    rooted = cut(join_counted(sets.select("key", "least"), roots, "key").withColumn("root", F.coalesce("root", "key")))
    named = cut(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "root", "component_id"))
    return join_counted(rows.select("id", "h", "key"), named, "key", "inner").select("id", "h", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (id, component_id) for each row of docs, with the least id among the documents that are reachable over similar pairs.

    Texts with the same shingles, such as all without words, are one document here; so groups
    of copies cost no pairs. Null ids and repeated rows are treated as simhash.near_duplicates does; very long texts
    are looked at whole; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    return _placed(docs, id_col, text_col).select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each near-duplicate group, as simhash.keep_one keeps it."""
    return keep_least(docs, cut(_placed(docs, id_col, text_col)), id_col, text_col)
