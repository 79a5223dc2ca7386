"""Two versions of sequences aligned by content, so that what was put in or taken out shifts nothing else."""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nested anchors are sought so often; deeper, the k-th occurrence of a content on one side stands for the k-th on the other.
DEPTH = 40


def rising(values: list[int]) -> list[int]:
    """The positions of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for k, x in enumerate(values):
        i = bisect.bisect_left(tails, x)
        if i == len(tails):
            tails.append(x)
            at.append(k)
        else:
            tails[i], at[i] = x, k
        before[k] = at[i - 1] if i else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def matched(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places (in a, in b) of equal elements, rising on both sides.

    Elements that occur once on either side are anchors, of which a longest rising sequence is kept; what
    lies between two anchors is matched likewise. Where there is no anchor, the k-th occurrence of an element stands for the k-th
    on the other side. Where all elements differ, this is a longest common subsequence.
    """
    out: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b), 0)]
    while open_:
        a0, a1, b0, b1, depth = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once = [Counter(x) for x in (a[a0:a1], b[b0:b1])]
        place = {b[k]: k for k in range(b0, b1) if once[1][b[k]] == 1}
        pairs = [(k, place[a[k]]) for k in range(a0, a1) if once[0][a[k]] == 1 and a[k] in place]
        nested = bool(pairs) and depth < DEPTH
        if not nested:
            seen: Counter = Counter()
            where = {}
            for k in range(b0, b1):
                where[(b[k], seen[b[k]])] = k
                seen[b[k]] += 1
            seen, pairs = Counter(), []
            for k in range(a0, a1):
                if (key := (a[k], seen[a[k]])) in where:
                    pairs.append((k, where[key]))
                seen[a[k]] += 1
        kept = [pairs[k] for k in rising([y for _, y in pairs])]
        out += kept
        if nested:
            ends = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            open_ += [(x0 + 1, x1, y0 + 1, y1, depth + 1) for (x0, y0), (x1, y1) in zip(ends, ends[1:])]
    return sorted(out)


def edits(a: list, b: list) -> Iterator[tuple[int | None, int | None, str]]:
    """Each element of a and b, with its place on both sides: same, moved, changed, removed or added.

    Of what isn't matched, equal elements have moved, the k-th of one side being the k-th of the other; the rest between two matches
    is paired off in order as changed, until one side has no more.
    """
    same = matched(a, b)
    yield from ((x, y, "same") for x, y in same)
    used_a, used_b = {x for x, _ in same}, {y for _, y in same}
    spare = defaultdict(list)
    for y in range(len(b) - 1, -1, -1):
        if y not in used_b:
            spare[b[y]].append(y)
    for x in range(len(a)):
        if x not in used_a and spare.get(a[x]):
            y = spare[a[x]].pop()
            used_a.add(x)
            used_b.add(y)
            yield x, y, "moved"
    ends = [(-1, -1), *same, (len(a), len(b))]
    for (x0, y0), (x1, y1) in zip(ends, ends[1:]):
        old, new = [x for x in range(x0 + 1, x1) if x not in used_a], [y for y in range(y0 + 1, y1) if y not in used_b]
        yield from ((x, y, "changed") for x, y in zip(old, new))
        yield from ((x, None, "removed") for x in old[len(new) :])
        yield from ((None, y, "added") for y in new[len(old) :])


def aligned(old: DataFrame, new: DataFrame, key: str = "conv_id", order: str = "turn", content: tuple[str, ...] = ("role", "text")) -> DataFrame:
    """Rows (key, old_turn, new_turn, change) for two versions of sequences; change is that of edits().

    Elements are compared by a digest of their content columns, a null being unlike an empty text. Rows of one place are ordered by their digests;
    repeated rows count each; a null key is a key; a sequence that only one version has is removed or added as a whole. Texts
    aren't shuffled: a sequence goes to one task as (side, place, digest), some 60 bytes an element.
    """

    def narrow(df: DataFrame, side: int) -> DataFrame:
        told = F.to_json(F.struct(*content), {"ignoreNullFields": "false"})
        return df.select(F.col(key).alias("key"), F.lit(side).alias("side"), F.col(order).cast("bigint").alias("place"), F.unhex(F.sha2(told, 256)).alias("digest"))

    def diff(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "place", "digest"], na_position="first")
        sides = [rows[rows["side"] == k] for k in (0, 1)]
        places = [[None if pd.isna(x) else int(x) for x in s["place"]] for s in sides]
        found = [(None if x is None else places[0][x], None if y is None else places[1][y], kind) for x, y, kind in edits(*[list(map(bytes, s["digest"])) for s in sides])]
        columns = list(zip(*found))
        out = pd.DataFrame({"old_turn": pd.array(columns[0], dtype="Int64"), "new_turn": pd.array(columns[1], dtype="Int64"), "change": list(columns[2])})
        return out.assign(key=rows["key"].iloc[0])[["key", "old_turn", "new_turn", "change"]]

    both = narrow(old, 0).unionByName(narrow(new, 1))
    kind = both.schema["key"].dataType.simpleString()
    found = both.groupBy("key").applyInPandas(diff, f"key {kind}, old_turn bigint, new_turn bigint, change string")
    return found.select(F.col("key").alias(key), "old_turn", "new_turn", "change")
