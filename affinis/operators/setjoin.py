"""Exact self-join of sets by their rare tokens.

Tokens are ordered by how often they occur. Of a set of n tokens the first n - ceil(threshold * n) + 1 travel to the cells of a
triangle: two sets that are similar enough share one of these at least, and how many they share there bounds how many they share
in all. So a cell counts shared tokens of pairs whose sizes fit, by a product of sparse incidence matrices, block by block; the few
pairs that the count leaves are compared token by token. Equal sets are compared once, and listed as members of their class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions.families import Hasher, as_lists
from affinis.operators import selfjoin
from affinis.plans.params import triangle_groups
from affinis.sources.io import cut

#: Frequencies are counted for so many groups of tokens (a power of two), and sent in so many parts.
TOKEN_GROUPS, PARTS = 1 << 22, 64
#: Pairs of a block, whose counts should fit a core's cache; shared tokens of a block and tokens that are looked up together, about.
COUNTS, SHARED, LOOKED_UP = 1 << 18, 1 << 22, 1 << 21
#: Bits of a row's number in the index of a cell; levels of frequency for which a set's rarer tokens are counted.
ROW_BITS, LEVELS = 31, 64


def group_of(tokens: np.ndarray) -> np.ndarray:
    return ((tokens.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TOKEN_GROUPS.bit_length() + 1)).astype(np.int64)


def token_classes(rows: DataFrame) -> np.ndarray:
    """For each group of tokens 0 if none of its tokens occurs, 1 if they occur once, and more the more often: all rows are counted. A few MB, whatever the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(TOKEN_GROUPS, np.int64)
        for b in batches:
            n += np.bincount(group_of(b.column(0).flatten().to_numpy(zero_copy_only=False)), minlength=TOKEN_GROUPS)
        few = np.minimum(n, 65535).astype(np.uint16).reshape(PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([x.tobytes() for x in few], pa.binary())], names=["part", "n"])

    def add(part: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for x in part["n"])
        level = np.where(n > 0, 1 + 4 * np.log2(np.maximum(n, 1)), 0).astype(np.uint8)
        return pa.table({"part": part["part"].slice(0, 1), "n": pa.array([level.tobytes()], pa.binary())})

    got = rows.select("v").mapInArrow(count, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect()
    return np.frombuffer(b"".join(r["n"] for r in sorted(got, key=lambda r: r["part"])), np.uint8) if got else np.zeros(TOKEN_GROUPS, np.uint8)


def prefixes(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, f1, f2, size, rest, last, below, p): digests and size of a set, how many tokens follow its prefix, the place of the last of the prefix in the order, how many of its tokens are rarer than each level, and 32 bits of each token of the prefix that another set may have."""
    level = token_classes(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, at = selfjoin.lists_of(b.column(1))
            size = np.diff(at)
            row = np.repeat(np.arange(len(size)), size)
            often = level[group_of(flat)]
            order = np.lexsort((flat, often, row))
            flat, often = flat[order], often[order]
            length = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
            last = at[:-1] + length - 1
            place = (often[last].astype(np.int64) << 55) | ((flat[last] >> 9) + (1 << 54))
            keep = (np.arange(len(flat)) - at[row] < length[row]) & (often > 1)
            code = ((flat[keep].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            offsets = np.append(0, np.cumsum(np.bincount(row[keep], minlength=len(size)))).astype(np.int32)
            p = pa.ListArray.from_arrays(pa.array(offsets), pa.array(code))
            n = np.bincount(row * LEVELS + np.minimum(often, LEVELS - 1), minlength=len(size) * LEVELS).reshape(-1, LEVELS)
            below = as_lists(np.minimum(n.cumsum(1) - n, 32767).astype(np.int16), pa.int16())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(size.astype(np.int32)), pa.array((size - length).astype(np.int32)), pa.array(place), below, p], names=["id", "f1", "f2", "size", "rest", "last", "below", "p"])

    some = rows.select("id", "v", F.xxhash64("v").alias("f1"), F.xxhash64("v", F.lit(1)).alias("f2"))
    return some.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, f1 bigint, f2 bigint, size int, rest int, last bigint, below array<smallint>, p array<int>")


def sharing(left: dict[str, np.ndarray], right: dict[str, np.ndarray], threshold: float, diagonal: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) whose prefixes share enough; both sides are sorted by size. On the diagonal those with i < j."""
    share = threshold / (1 + threshold)
    ol, nr = left["at"], len(right["size"])
    mask = (1 << ROW_BITS) - 1
    index = np.sort(right["code"] << ROW_BITS | np.repeat(np.arange(nr), np.diff(right["at"])))
    low = np.searchsorted(right["size"], left["size"] * threshold - 1e-9)
    high = np.searchsorted(right["size"], left["size"] / threshold + 1e-9, "right")
    if diagonal:
        low = np.maximum(low, np.arange(len(low)) + 1)
    top = 0
    while top < len(low):
        end = max(top + 1, int(np.searchsorted(ol, ol[top] + LOOKED_UP, "right")) - 1)
        row = np.repeat(np.arange(top, end), np.diff(ol[top : end + 1]))
        code = left["code"][ol[top] : ol[end]]
        order = np.argsort(code, kind="stable")
        begin, n = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        begin[order] = np.searchsorted(index, code[order] << ROW_BITS | low[row[order]])
        n[order] = np.searchsorted(index, code[order] << ROW_BITS | high[row[order]]) - begin[order]
        some = np.flatnonzero(n > 0)
        row, begin, n = row[some], begin[some], n[some]
        before = np.append(0, np.cumsum(n))
        i0 = top
        while i0 < end:
            first = low[i0]
            i1 = min(end, i0 + max(1, COUNTS // max(1, int(high[i0] - first))))
            k0, k1 = np.searchsorted(row, i0), np.searchsorted(row, i1)
            if before[k1] - before[k0] > SHARED:
                i1 = max(i0 + 1, int(row[np.searchsorted(before, before[k0] + SHARED) - 1]))
                k1 = np.searchsorted(row, i1)
            width = int(high[i1 - 1] - first)
            if width > 0 and k1 > k0:
                m = n[k0:k1]
                j = index[np.repeat(begin[k0:k1] - (before[k0:k1] - before[k0]), m) + np.arange(int(m.sum()))] & mask
                count = np.bincount(np.repeat((row[k0:k1] - i0) * width - first, m) + j, minlength=(i1 - i0) * width)
                least = share * (left["size"][i0] + right["size"][first : first + width]) - np.maximum(left["rest"][i0:i1].max(), right["rest"][first : first + width])
                at = np.flatnonzero(count.reshape(-1, width) >= np.maximum(1, np.ceil(least - 1e-9)).astype(np.int64))
                i, j = np.divmod(at, width)
                i, j = i + i0, j + first
                rest_l, rest_r, last_l, last_r = left["rest"][i], right["rest"][j], left["last"][i], right["last"][j]
                # What is counted is all that they share up to the earlier of the ends of the prefixes; after it neither shares more than it has left.
                rest = np.where(last_l < last_r, rest_l, np.where(last_r < last_l, rest_r, np.maximum(rest_l, rest_r)))
                level = np.minimum(np.minimum(last_l, last_r) >> 55, LEVELS - 1)
                a, b = left["size"][i], right["size"][j]
                rest = np.minimum(rest, np.minimum(a - left["below"][i, level], b - right["below"][j, level]))
                ok = count[at] + rest >= share * (a + b) - 1e-9
                if ok.any():
                    yield i[ok], j[ok]
            i0 = i1
        top = end


def set_columns(rows: pa.Table) -> tuple[pa.Table, dict[str, np.ndarray]]:
    rows = rows.take(pa.array(np.argsort(rows["size"].to_numpy(), kind="stable"))).combine_chunks()
    code, at = selfjoin.lists_of(rows["p"].combine_chunks())
    return rows, {"code": code.astype(np.int64) & 0xFFFFFFFF, "at": at} | {c: rows[c].to_numpy().astype(np.int64) for c in ("size", "rest", "last")} | {"below": rows["below"].combine_chunks().flatten().to_numpy().reshape(-1, LEVELS)}


def set_pairs(rows: DataFrame, threshold: float, groups: int | None = None, hasher: Hasher | None = None, limit: int = 0) -> DataFrame:
    """(id_l, id_r, similarity) of the sets that are at least so similar; with a hasher, of those that collide in some repetition (of each level) and whose sketches allow it."""
    slim = cut(prefixes(rows, threshold))
    total = slim.agg(F.count("*").alias("n"), F.sum(F.size("p")).alias("tokens")).first()
    slots = rows.sparkSession.sparkContext.defaultParallelism
    groups = groups or max(triangle_groups(2 * slots), -(-((64 + 2 * LEVELS) * total["n"] + 4 * (total["tokens"] or 0)) // selfjoin.GROUP_BYTES))
    first = [F.first(c).alias(c) for c in ("size", "rest", "last", "below", "p")]
    classes = slim.groupBy("f1", "f2").agg(F.min("id").alias("id"), *first)
    kind = dict(rows.dtypes)["id"]

    def solve(left: pa.Table, right: pa.Table, diagonal: bool) -> Iterator[pa.Table]:
        left, l = set_columns(left)
        right, r = (left, l) if diagonal else set_columns(right)
        for i, j in sharing(l, r, threshold, diagonal):
            yield selfjoin.pair_table(left["id"], right["id"], i, j, None, left.schema.field("id").type)

    found = cut(selfjoin.per_cell(classes.select("id", "size", "rest", "last", "below", "p"), groups, solve, f"id_l {kind}, id_r {kind}"))
    ids = found.select(F.explode(F.array("id_l", "id_r")).alias("id")).distinct()
    own = cut(rows.join(ids, "id", "left_semi"))
    near = selfjoin.verify(found, own, "jaccard", 0).where(F.col("similarity") >= threshold - 1e-12)
    if hasher:
        near = collided(near, own, hasher, limit)
    members = slim.join(slim.groupBy("f1", "f2").agg(F.min("id").alias("class")), ["f1", "f2"]).select("id", "class")
    a, b = members.select(F.col("id").alias("a"), F.col("class").alias("id_l")), members.select(F.col("id").alias("b"), F.col("class").alias("id_r"))
    across = near.join(a, "id_l").join(b, "id_r").select(F.least("a", "b").alias("id_l"), F.greatest("a", "b").alias("id_r"), "similarity")
    within = a.join(b, F.col("id_l") == F.col("id_r")).where("a < b").select(F.col("a").alias("id_l"), F.col("b").alias("id_r"), F.lit(1.0).alias("similarity"))
    return across.unionByName(within)


def collided(near: DataFrame, rows: DataFrame, hasher: Hasher, limit: int) -> DataFrame:
    """The pairs of near that hashing finds."""
    hashed = hasher.add(rows)
    names = [c for c in hashed.columns if c not in ("id", "bitmap")]
    side = lambda s: hashed.select(F.col("id").alias(f"id_{s}"), F.struct(*names).alias(s))
    both = near.join(side("l"), "id_l").join(side("r"), "id_r").select("id_l", "id_r", "similarity", "l", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            l, r = (selfjoin.slim_columns(pa.Table.from_arrays([*b.column(k).flatten(), as_lists(np.zeros((b.num_rows, 0), np.int64), pa.int64())], names=[*names, "bitmap"]), hasher) for k in (3, 4))
            every = np.arange(b.num_rows)
            ok = selfjoin.colliding(l, r, every, every, hasher, limit) if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(ok)) for k in range(3)], names=["id_l", "id_r", "similarity"])

    kind = dict(near.dtypes)["id_l"]
    return both.mapInArrow(run, f"id_l {kind}, id_r {kind}, similarity double")


__all__ = ["set_pairs"]
