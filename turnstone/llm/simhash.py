"""Near-duplicate detection: SimHash fingerprints, linked by pigeonring filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, join_counted, lean

BITS = 64
#: Hash values whose bits are counted at once, which bounds memory on very long texts.
CHUNK = 1 << 16


def _counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, from the least bit up."""
    table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(columns[:, k], minlength=256) @ table for k in range(8)])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text; its words are split at ASCII white space, A-Z lower-cased.

    A bit is 1 if set in over half of the XXH64 values (seed 42) of the shingles,
    repeats included. Fewer words than width make one shingle; no word makes 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n, counts, hashed = max(1, len(words) - width + 1), np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for start in range(0, n, CHUNK):
        part = [hashed(b" ".join(words[i : i + width]), 42) for i in range(start, min(n, start + CHUNK))]
        counts += _counts(np.array(part, dtype=np.uint64))
    return int(sum(1 << k for k in np.flatnonzero(2 * counts > n).tolist()))


def simhash(hashes: np.ndarray) -> int:
    """The SimHash of some shingles' hashes (uint64), any number of them: a bit is 1 if set in over half."""
    counts = sum(_counts(hashes[k : k + CHUNK]) for k in range(0, len(hashes), CHUNK)) if len(hashes) else np.zeros(BITS, np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def fingerprint_column(text, width: int = 3):
    """The fingerprints of a text column, as signed longs."""

    @F.arrow_udf("bigint")
    @lean
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), width) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text)


def distance_of(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def near_links(prints: DataFrame, distance: int = 2, segments: int = 16, bucket_limit: int = 16, rows: int | None = None) -> DataFrame:
    """Links (u, v) that join the same sets as all pairs of distinct fp at most `distance` bits apart.

    Pigeonring: the bits form a ring of `segments` equal segments. If two
    fingerprints differ in at most d bits, some segment starts a chain in which each
    first l segments differ in at most floor(l * d / segments) bits, for every l.
    The chain's leading lengths with budget 0 must agree exactly, so their bits and
    the start are the bucket; what remains of the chain is checked length by length
    before the full distance.

    A bucket of more than bucket_limit fingerprints is never paired up. Its members
    are linked exactly through the points of radius d // 2 around them instead:
    two of them are within d = 2 bits just if they share such a point, and each
    member of a point is linked to the least one. So work grows in proportion to
    the fingerprints, whatever their groups. Expects distinct, non-null fp (long); rows:
    a bound of their number, if known.
    """
    if distance != 2 or BITS % segments or segments <= distance:
        raise ValueError("distance must be 2, and segments a divisor of 64 above 2")
    width = BITS // segments
    budgets = [length * distance // segments for length in range(1, segments + 1)]
    free = budgets.count(0)

    def turned(fp, by: int):  # the ring, turned so that segment `by` comes first (in the high bits)
        left = by * width
        return fp if not left else F.shiftleft(fp, left).bitwiseOR(F.shiftrightunsigned(fp, BITS - left))

    starts = F.array(*[F.struct(F.lit(i).alias("start"), turned(F.col("fp"), i).alias("ring")) for i in range(segments)])
    keyed = prints.select(F.explode(starts).alias("s")).select("s.*").withColumn("bucket", F.shiftrightunsigned("ring", BITS - free * width))
    sizes = keyed.groupBy("start", "bucket").count().where("count > 1")
    shared = cut(keyed.join(sizes, ["start", "bucket"]), rows and rows * segments)

    pair = shared.where(F.col("count") <= bucket_limit).select("start", "bucket", "ring")
    chain = F.lit(True)
    differ = F.col("a.ring").bitwiseXOR(F.col("b.ring"))
    for length in range(free + 1, segments + 1):
        chain &= F.bit_count(F.shiftrightunsigned(differ, BITS - length * width)) <= budgets[length - 1]
    close = pair.alias("a").join(
        pair.alias("b"),
        (F.col("a.start") == F.col("b.start")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.ring") < F.col("b.ring")) & chain & (F.bit_count(differ) <= distance),
    )

    def back(ring: str, start: str):  # undoes turned(), for a start held in a column
        right = f"cast({start} * {width} as int)"
        return F.expr(f"CASE WHEN {start} = 0 THEN {ring} ELSE shiftrightunsigned({ring}, {right}) | shiftleft({ring}, {BITS} - {right}) END")

    links = close.select(back("a.ring", "a.start").alias("u"), back("b.ring", "a.start").alias("v"))

    hot = shared.where(F.col("count") > bucket_limit).select("start", "ring").alias("a").select(back("a.ring", "a.start").alias("fp")).distinct()
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(BITS)])
    points = hot.select("fp", F.explode(ball).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").select("point", "u")
    stars = points.join(least, "point").where("u <> fp").select("u", F.col("fp").alias("v"))
    return links.unionByName(stars).distinct()


def _placed(docs: DataFrame, distance: int, segments: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """A row (id, h, fp, root, component_id) for each row of docs; h is the text's hash, root a fingerprint."""
    rows = cut(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), fingerprint_column(F.col(text_col), width).alias("fp")))
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("least")), rows.count())
    n = prints.count()
    roots = cut(components(near_links(prints.select("fp"), distance, segments, rows=n)).toDF("fp", "root"), n)
    rooted = cut(join_counted(prints, roots, "fp").withColumn("root", F.coalesce("root", "fp")), n)
    named = cut(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id"), n)
    return join_counted(rows, named, "fp", "inner").select("id", "h", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 2, segments: int = 16, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (id, fingerprint, component_id) for each row of docs.

    component_id is the least id among the documents reachable over links of at
    most `distance` bits, the document's own included. Rows of equal fingerprints
    are first folded into one, so groups of copies cost no pairs. A null text
    has fingerprint zero, as has one without words; such rows are linked like any
    other. A row with a null id keeps it and gets its component's least non-null id
    (null if there is none). Repeated rows are all returned; other columns are ignored;
    very long texts are looked at whole; an empty table gives no rows.
    """
    found = _placed(docs, distance, segments, width, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 2, segments: int = 16, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each near-duplicate group, columns unchanged.

    The row with the least id stays. Of several rows of one group with that id (or of a group
    in which every id is null), the one whose text's hash is least does, and of several
    with one text that whose columns' hash is. An empty table gives no rows; columns of any
    name ride along.
    """
    return keep_least(docs, cut(_placed(docs, distance, segments, width, id_col, text_col)), id_col, text_col)


def keep_least(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """keep_one for groups that were found: placed is a table from cut() with (id, h, root, component_id), h the text's xxhash64.

    Rows are matched by id and text hash; whole texts are shuffled only if more rows go than can be broadcast.
    """
    own = {c: f"_turnstone_{c}" for c in ("id", "h", "n")}
    at_least = placed.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root", "id", "h").agg(F.count("*").alias("n"))
    kept = cut(at_least.groupBy("root").agg(F.min(F.struct("h", "id", "n")).alias("k")).select("root", "k.h", "k.id", "k.n"))
    stays = kept.select("root", F.col("h").alias("kept_h"), F.col("id").alias("kept_id"))
    goes = placed.join(stays, "root").where(~(F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_h")))).select("id", "h").distinct()
    many = kept.where("n > 1").select("id", "h")
    out = cut(goes.unionByName(many).select([F.col(c).alias(own[c]) for c in ("id", "h")]))
    on = F.col(id_col).eqNullSafe(F.col(own["id"])) & (F.xxhash64(text_col) == F.col(own["h"]))
    once = join_counted(docs, out, on, "left_anti")
    if many.isEmpty():
        return once
    names = docs.columns
    some = join_counted(docs, cut(many.select([F.col(c).alias(own[c]) for c in ("id", "h")])), on, "inner")
    spare = some.groupBy(own["id"], own["h"]).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias(own["n"]))
    return once.unionByName(spare.select(f"{own['n']}.*"))
