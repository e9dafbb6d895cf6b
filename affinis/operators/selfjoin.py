"""Similarity self-joins.

``similarity_self_join`` returns the pairs (id_l, id_r, similarity), id_l < id_r, of rows at least as
similar as the threshold: exactly (``cartesian``, ``sequential``), or each with probability of at least ``recall``
(``local-lsh``, ``one-level-lsh``, ``two-level-lsh``). Local and one-level hashing find the same
pairs for equal parameters. A pair that collides in several repetitions is reported in the first only,
which its two pools tell without a shuffle.

Pairs of sets pass two exact tests before their tokens are looked at: their sizes must allow the similarity, and
their bitmaps must not differ in more bits than it leaves tokens apart.

Input: rows with a null id, and null or empty values, take no part; of rows that repeat an id the least value counts.
Vectors must have the most frequent dimension (of equals: the smaller) and only finite numbers; others take no
part. Sets lose null and repeated tokens; tokens may be whole numbers, or strings, which are hashed to 64 bits.
Ids may be numbers or strings.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from affinis.functions.families import Hasher, hash_at, measure_of, none_equal, prefix_words, unpack_pool, words_of
from affinis.functions.measures import different_bits, jaccard, length_filter, let, normalize
from affinis.operators.cells import BOTH, LEFT, RIGHT, cell_array, triangle_cells
from affinis.plans.params import COSINE, Tensor, sketch_threshold, tensor, triangle_groups, two_level
from affinis.sources.io import cut

#: Bytes of a group of the triangle, about; a cell holds two groups.
GROUP_BYTES = 64 << 20
#: Rows of a bucket beyond which it is cut into groups of about this size; rows of a task that solves buckets, about.
HOT_ROWS, TASK_ROWS = 20000, 1 << 18
#: Bits of a set's bitmap, on average; twice as many where a row travels to cells only and not once a repetition.
BITS_PER_TOKEN = 4
#: Pairs that are looked at together.
PAIRS = 1 << 21
#: Similarity of sets from which their rare tokens decide which pairs are compared; below it too many tokens count as rare.
RARE_PAYS = 0.2
#: Rows of a block of the left side and of the right one, that products of vectors are made of; rows of a batch that leaves a task.
BLOCK, ROWS_OUT = (512, 2048), 1 << 18


def usable(df: DataFrame, id_col: str, value_col: str, unit: bool = False) -> tuple[DataFrame, str]:
    """(id, v), null where a value is not usable, and the measure; with unit, vectors are divided by their norms."""
    measure = measure_of(df, value_col)
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    v = name(value_col)
    if measure == COSINE:
        kind = df.schema[value_col].dataType.elementType
        v = v.cast("array<float>" if isinstance(kind, T.FloatType) and not unit else "array<double>")  # as wide as given: it travels
        v = F.when(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), normalize(v) if unit else v)
    else:
        texts = isinstance(df.schema[value_col].dataType.elementType, T.StringType)
        v = F.array_compact(v)
        v = F.sort_array(F.array_distinct(F.transform(v, lambda x: F.xxhash64(x)) if texts else v.cast("array<bigint>")))
    # let: what makes v may be costly, and must not be computed once more for the test.
    return df.where(name(id_col).isNotNull()).select(name(id_col).alias("id"), let(v, lambda x: F.when(F.size(x) > 0, x)).alias("v")), measure


def items(df: DataFrame, id_col: str, value_col: str, unit: bool = False) -> tuple[DataFrame, str, int]:
    """(id, v) with usable values, one row an id, the measure, and the dimension of vectors or the mean size of sets."""
    rows, measure = usable(df, id_col, value_col, unit)
    rows = cut(rows.groupBy("id").agg(F.min("v").alias("v")).where("v IS NOT NULL"))  # read several times, and often made from text
    if measure != COSINE:
        return rows, measure, int(rows.agg(F.ceil(F.avg(F.size("v")))).first()[0] or 0)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = sizes[0]["n"] if sizes else 0
    return rows.where(F.size("v") == dim), measure, dim


def lists_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(np.asarray(arr.offsets))
    return arr.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size))


def overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], often: int = 32) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: frequent tokens by products of incidence matrices, rare ones pair by pair."""
    (fa, oa), (fb, ob) = a, b
    _, code = np.unique(np.concatenate([fa, fb]), return_inverse=True)
    ca, cb = code[: len(fa)], code[len(fa) :]
    ra, rb = np.repeat(np.arange(len(oa) - 1), np.diff(oa)), np.repeat(np.arange(len(ob) - 1), np.diff(ob))
    na, nb = (np.bincount(c, minlength=int(code.max(initial=-1)) + 1) for c in (ca, cb))
    out = np.zeros((len(oa) - 1, len(ob) - 1), np.float32)
    hot = np.flatnonzero(na * nb > often * often)
    place = np.full(len(na), -1)
    for lo in range(0, len(hot), 2048):
        some = hot[lo : lo + 2048]
        place[:] = -1
        place[some] = np.arange(len(some))
        x, y = np.zeros((len(out), len(some)), np.float32), np.zeros((out.shape[1], len(some)), np.float32)
        for m, c, r in ((x, ca, ra), (y, cb, rb)):
            on = place[c] >= 0
            m[r[on], place[c[on]]] = 1
        out += x @ y.T
    rare = (na * nb > 0) & (na * nb <= often * often)
    ka, kb = np.flatnonzero(rare[ca]), np.flatnonzero(rare[cb])
    ka = ka[np.argsort(ca[ka], kind="stable")]
    kb = kb[np.argsort(cb[kb], kind="stable")]
    lo, hi = np.searchsorted(cb[kb], ca[ka], "left"), np.searchsorted(cb[kb], ca[ka], "right")
    n = hi - lo
    cum = np.cumsum(n) - n
    left = np.repeat(ra[ka], n)
    right = rb[kb][np.repeat(lo - cum, n) + np.arange(int(n.sum()))] if len(left) else left
    if len(left):
        out += np.bincount(left * out.shape[1] + right, minlength=out.size).reshape(out.shape)
    return out


def all_similarities(measure: str, a: pa.Array, b: pa.Array, dim: int) -> np.ndarray:
    if measure == COSINE:
        x, y = (c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) for c in (a, b))
        return x @ y.T
    la, lb = lists_of(a), lists_of(b)
    both = overlaps(la, lb).astype(np.float64)
    return both / np.maximum(np.diff(la[1])[:, None] + np.diff(lb[1])[None] - both, 1)


def per_cell(rows: DataFrame, groups: int, solve: Callable[[pa.Table, pa.Table, bool], Iterator[pa.Table]], schema: str) -> DataFrame:
    """Replicate rows to the triangle's cells, a task each, and run solve(left rows, right rows, whether they are the same) there; what it yields leaves part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        del got
        cells = table["cell_i"].to_numpy().astype(np.int64) * groups + table["cell_j"].to_numpy()
        for c in np.unique(cells):
            side = table["side"].to_numpy()
            diagonal = c // groups == c % groups
            at = [np.flatnonzero((cells == c) & (side == s)) for s in ((BOTH,) if diagonal else (RIGHT, LEFT))]
            left, right = (table.take(pa.array(at[k])).combine_chunks() for k in (0, -1))
            if not left.num_rows or not right.num_rows:
                continue
            for part in solve(left, right, diagonal):
                yield from part.to_batches(ROWS_OUT)

    d = F.col("cell_j") - F.col("cell_i")
    number = d * groups - (d * (d - 1) / 2).cast("int") + F.col("cell_i")
    return triangle_cells(rows, groups).repartitionById(groups * (groups + 1) // 2, number.cast("int")).mapInArrow(run, schema)


def group_count(rows: DataFrame, row_bytes: int) -> int:
    """Groups enough for the cluster's slots, and for cells of bounded size; a row is copied once for each."""
    return max(triangle_groups(rows.sparkSession.sparkContext.defaultParallelism), -(-rows.count() * row_bytes // GROUP_BYTES))


def pair_table(ids_l: pa.ChunkedArray, ids_r: pa.ChunkedArray, i: np.ndarray, j: np.ndarray, sim: np.ndarray | None, kind: pa.DataType) -> pa.Table:
    a, b = ids_l.to_numpy()[i], ids_r.to_numpy()[j]
    out = {"id_l": pa.array(np.minimum(a, b), kind), "id_r": pa.array(np.maximum(a, b), kind)}
    return pa.table(out | ({} if sim is None else {"similarity": pa.array(sim.astype(np.float64))}))


def joined(found: list[tuple[np.ndarray, ...]], width: int) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * width


def matrix(rows: pa.Table, dim: int) -> np.ndarray:
    return rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def near_vectors(x: np.ndarray, y: np.ndarray, threshold: float, diagonal: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, similarity) of the rows of x and y that are near, block by block; on the diagonal those with i < j."""
    for lo, begin, sim in products(x, y, diagonal):
        ok = sim >= threshold - 1e-12
        if diagonal and begin < lo + len(sim):
            ok &= np.arange(lo, lo + len(sim))[:, None] < np.arange(begin, begin + sim.shape[1])[None]
        at = np.flatnonzero(ok)
        if len(at):
            i, j = np.divmod(at, sim.shape[1])
            yield i + lo, j + begin, sim.ravel()[at]


def products(x: np.ndarray, y: np.ndarray, diagonal: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row of x, first row of y, products) for each block; on the diagonal no block that lies below it."""
    for begin in range(0, len(y), BLOCK[1]):
        some = y[begin : begin + BLOCK[1]].astype(np.float64)
        for lo in range(0, min(len(x), begin + len(some)) if diagonal else len(x), BLOCK[0]):
            yield lo, begin, x[lo : lo + BLOCK[0]].astype(np.float64) @ some.T


def hashed_cells(rows: DataFrame, hasher: Hasher, threshold: float, limit: int, groups: int) -> DataFrame:
    """The pairs that hashing finds, by products of blocks: near ones first, then those of them that collide at each level and whose sketches allow it.

    Where most pairs collide somewhere, as with few bits, this lists the near pairs only, and not all that collide.
    """

    def solve(left: pa.Table, right: pa.Table, diagonal: bool) -> Iterator[pa.Table]:
        l, r = slim_columns(left, hasher), slim_columns(right, hasher)
        for i, j, sim in near_vectors(matrix(left, hasher.dim), matrix(right, hasher.dim), threshold, diagonal):
            ok = colliding(l, r, i, j, hasher, limit)
            yield pair_table(left["id"], right["id"], i[ok], j[ok], sim[ok], left.schema.field("id").type)

    kind = dict(rows.dtypes)["id"]
    return per_cell(hasher.add(rows, keep_value=True), groups, solve, f"id_l {kind}, id_r {kind}, similarity double")


def colliding(l: dict[str, np.ndarray], r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, hasher: Hasher, limit: int) -> np.ndarray:
    """Whether each pair collides in some repetition (of each level) and its sketches don't rule it out."""
    ok = meeting(l, r, i, j, hasher.scheme) < hasher.scheme.repetitions
    if hasher.inner:
        ok &= meeting(l, r, i, j, hasher.inner, "2") < hasher.inner.repetitions
    if hasher.sketch_bits:
        ok &= np.bitwise_count(l["sketch"][i] ^ r["sketch"][j]).sum(1) <= limit
    return ok


def blocks_pay(hasher: Hasher) -> bool:
    """Whether comparing all pairs by blocks is cheaper than listing those that collide: of unrelated pairs at least repetitions / 2^k do, and to list one costs as much as dozens of products."""
    return hasher.scheme.repetitions * 4096 >= hasher.dim << hasher.scheme.k


def scheme_lists_many(hasher: Hasher) -> bool:
    """Whether sets are joined by their rare tokens, and what collides is kept: of unrelated pairs at least repetitions / 2^k collide, far more than share rare tokens."""
    return hasher.scheme.repetitions * 256 >= 1 << hasher.scheme.k


def cartesian(rows: DataFrame, measure: str, dim: int, threshold: float, groups: int, words: int = 0) -> DataFrame:
    """Exact. Vectors meet in blocks by products of matrices; sets by size, then bitmaps, then tokens."""

    def vectors(left: pa.Table, right: pa.Table, diagonal: bool) -> Iterator[pa.Table]:
        for i, j, sim in near_vectors(matrix(left, dim), matrix(right, dim), threshold, diagonal):
            yield pair_table(left["id"], right["id"], i, j, sim, left.schema.field("id").type)

    def sets(left: pa.Table, right: pa.Table, diagonal: bool) -> Iterator[pa.Table]:
        left, right = (t.take(pa.array(np.argsort(t["size"].to_numpy(), kind="stable"))).combine_chunks() for t in (left, right))
        l, r = slim_columns(left, None), slim_columns(right, None)
        found = []
        lo = 0
        while lo < left.num_rows:
            least = l["size"][lo]
            begin = max(lo + 1 if diagonal else 0, int(np.searchsorted(r["size"], least * threshold - 1e-9)))
            step = max(1, min(256, PAIRS // max(1, right.num_rows - begin)))
            end = int(np.searchsorted(r["size"], l["size"][min(lo + step, left.num_rows) - 1] / max(threshold, 1e-9) + 1e-9, "right"))
            x, y = l["bitmap"][lo : lo + step], r["bitmap"][begin:end]
            apart = np.zeros((len(x), len(y)), np.uint16)
            for w in range(words):
                apart += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
            near = apart <= apart_most(l["size"][lo : lo + step, None], r["size"][None, begin:end], threshold)
            if diagonal:
                near &= np.arange(lo, lo + len(x))[:, None] < np.arange(begin, end)[None]
            i, j = np.nonzero(near)
            found.append((i + lo, j + begin))
            lo += step
        i, j = joined(found, 2)
        sim = set_similarities(left["v"].combine_chunks(), right["v"].combine_chunks(), i, j, threshold)
        ok = sim >= threshold - 1e-12
        yield pair_table(left["id"], right["id"], i[ok], j[ok], sim[ok], left.schema.field("id").type)

    kind = dict(rows.dtypes)["id"]
    return per_cell(rows, groups, vectors if measure == COSINE else sets, f"id_l {kind}, id_r {kind}, similarity double")


def sequential(df: DataFrame, id_col: str, value_col: str, threshold: float) -> int:
    """The number of pairs, by one plain loop over all of them in one process: what the other algorithms are held against."""
    rows, measure, dim = items(df, id_col, value_col)
    got = rows.toArrow()
    v = got["v"].combine_chunks()
    if measure == COSINE:
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if len(v) else np.zeros((0, 1))
        return sum(int((x[i + 1 :] @ x[i] >= threshold - 1e-12).sum()) for i in range(len(x)))
    tokens = [set(t) for t in v.to_pylist()]
    return sum(len(a & b) >= (threshold - 1e-12) * len(a | b) for i, a in enumerate(tokens) for b in tokens[:i])


def apart_most(size_l: np.ndarray, size_r: np.ndarray, threshold: float) -> np.ndarray:
    """Most tokens that two sets of these sizes may not share if they are to reach the similarity."""
    return (size_l + size_r) * ((1 - threshold) / (1 + threshold)) + 1e-9


def bucket_pairs(a: np.ndarray, b: np.ndarray, diagonal: bool, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with a[i] = b[j], in parts of about so many; on the diagonal, where a is b, those with i < j."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = hi - lo
    total = np.cumsum(n)
    begin = 0
    while begin < len(a):
        before = total[begin] - n[begin]
        end = max(begin + 1, int(np.searchsorted(total, before + most, "right")))
        m = n[begin:end]
        i = np.repeat(np.arange(begin, end), m)
        j = order[np.repeat(lo[begin:end] - (np.cumsum(m) - m), m) + np.arange(len(i))]
        if diagonal:
            keep = i < j
            i, j = i[keep], j[keep]
        if len(i):
            yield i, j
        begin = end


def set_similarities(a: pa.Array, b: pa.Array, i: np.ndarray, j: np.ndarray, threshold: float = 0.0) -> np.ndarray:
    """Jaccard similarities of sets i of a and j of b; 0 where the sizes leave them below the threshold."""
    (fa, oa), (fb, ob) = lists_of(a), lists_of(b)
    na, nb = np.diff(oa)[i], np.diff(ob)[j]
    out = np.zeros(len(i))
    if not len(i):
        return out
    known, code = np.unique(np.concatenate([fa, fb]), return_inverse=True)
    ca, cb = code[: len(fa)], code[len(fa) :]
    mark = np.zeros(len(known), np.int32)
    order = np.flatnonzero(np.minimum(na, nb) >= (threshold - 1e-12) * np.maximum(na, nb))
    order = order[np.argsort(i[order], kind="stable")]
    left = i[order]
    cuts = np.flatnonzero(np.diff(left)) + 1
    for rows in np.split(order, cuts) if len(order) else []:  # the pairs of one left set
        own = ca[oa[i[rows[0]]] : oa[i[rows[0]] + 1]]
        mark[own] = 1
        for k in range(0, len(rows), 4096):
            some = rows[k : k + 4096]
            begin, n = ob[j[some]], nb[some]
            at = np.cumsum(n) - n
            both = np.add.reduceat(mark[cb[np.repeat(begin - at, n) + np.arange(int(n.sum()))]], at)
            out[some] = both / (len(own) + n - both)
        mark[own] = 0
    return out


def row_similarities(measure: str, a: pa.Array, b: pa.Array, dim: int) -> np.ndarray:
    """Of vectors row by row."""
    x, y = (c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) for c in (a, b))
    return np.einsum("ij,ij->i", x, y)


def slim_columns(rows: pa.Table, hasher: Hasher | None) -> dict[str, np.ndarray]:
    """The arrays of hashed rows; pools unpacked."""

    def wide(name: str, kind: type = np.int64) -> np.ndarray:
        c = rows[name].combine_chunks()
        return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).view(kind) if len(c) else np.zeros((0, 1), kind)

    out = {"size": rows["size"].to_numpy().astype(np.int64), "bitmap": wide("bitmap", np.uint64)}
    if hasher:
        out["sketch"] = wide("sketch", np.uint64)
        for level, scheme in (("", hasher.scheme), ("2", hasher.inner)):
            if scheme:
                out |= {n + level: unpack_pool(wide(n + level), scheme.hashers) for n in ("left", "right")}
    return out


def passing(l: dict[str, np.ndarray], r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, hasher: Hasher, limit: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sizes, bitmaps and sketches don't rule them out."""
    if hasher.bitmap_words:
        a, b = l["size"][i], r["size"][j]
        ok = np.minimum(a, b) >= (threshold - 1e-12) * np.maximum(a, b)
        i, j, a, b = i[ok], j[ok], a[ok], b[ok]
        ok = np.bitwise_count(l["bitmap"][i] ^ r["bitmap"][j]).sum(1, dtype=np.int64) <= apart_most(a, b, threshold)
        i, j = i[ok], j[ok]
    if hasher.sketch_bits:
        ok = np.bitwise_count(l["sketch"][i] ^ r["sketch"][j]).sum(1) <= limit
        i, j = i[ok], j[ok]
    return i, j


def meeting(l: dict[str, np.ndarray], r: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, scheme: Tensor, level: str = "") -> np.ndarray:
    """The first repetition in which each pair collides; the number of repetitions, or more, where there is none."""
    x, y = (l[n + level][i] == r[n + level][j] for n in ("left", "right"))
    return np.where(x.any(1) & y.any(1), x.argmax(1) * scheme.hashers + y.argmax(1), scheme.repetitions)


def hash_of(side: dict[str, np.ndarray], rep: int, scheme: Tensor, level: str = "") -> np.ndarray:
    x, y = divmod(rep, scheme.hashers)
    return side["left" + level][:, x].astype(np.int64) << scheme.k_right | side["right" + level][:, y]


def value_bytes(rows: DataFrame, dim: int) -> int:
    """Of a vector as it travels."""
    return dim * (4 if dict(rows.dtypes)["v"] == "array<float>" else 8)


def row_bytes(hasher: Hasher, value: int = 0) -> int:
    """Of a hashed row, with so many bytes of its value."""
    pools = sum(2 * words_of(scheme.hashers) for scheme in (hasher.scheme, hasher.inner) if scheme)
    return 64 + 8 * (pools + hasher.sketch_bits // 64 + hasher.bitmap_words) + value


def local_lsh(rows: DataFrame, hasher: Hasher, threshold: float, limit: int, groups: int | None = None) -> DataFrame:
    """Rows are hashed once and travel once, to their cells; all repetitions run inside a cell. Sets stay at home: their pools and bitmaps travel, and tokens join to the pairs that are left."""
    measure, dim, scheme = hasher.measure, hasher.dim, hasher.scheme
    vectors = measure == COSINE
    hashed = hasher.add(rows, keep_value=vectors)

    def solve(left: pa.Table, right: pa.Table, diagonal: bool) -> Iterator[pa.Table]:
        l, r = slim_columns(left, hasher), slim_columns(right, hasher)
        kind = left.schema.field("id").type
        for rep in range(scheme.repetitions):
            for i, j in bucket_pairs(hash_of(l, rep, scheme), hash_of(r, rep, scheme), diagonal):
                i, j = passing(l, r, i, j, hasher, limit, threshold)
                new = meeting(l, r, i, j, scheme) == rep
                i, j = i[new], j[new]
                if not vectors:
                    yield pair_table(left["id"], right["id"], i, j, None, kind)
                    continue
                for lo in range(0, len(i), 65536):
                    a, b = i[lo : lo + 65536], j[lo : lo + 65536]
                    s = row_similarities(measure, left["v"].take(pa.array(a)).combine_chunks(), right["v"].take(pa.array(b)).combine_chunks(), dim)
                    ok = s >= threshold - 1e-12
                    yield pair_table(left["id"], right["id"], a[ok], b[ok], s[ok], kind)

    kind = dict(rows.dtypes)["id"]
    if groups is None:
        groups = group_count(rows, row_bytes(hasher, value_bytes(rows, dim) if vectors else 0))
    pairs = per_cell(hashed, groups, solve, f"id_l {kind}, id_r {kind}" + (", similarity double" if vectors else ""))
    return pairs if vectors else verify(pairs, rows, measure, dim).where(F.col("similarity") >= threshold - 1e-12)


def exploded(hashed: DataFrame, hasher: Hasher) -> DataFrame:
    """hashed with rep and hash: a row for each repetition."""
    scheme = hasher.scheme
    # Few input files must not mean few tasks for the explosion; slim rows are cheap to spread.
    spread = hashed.repartition(int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    return spread.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(scheme.repetitions - 1)))).withColumn("hash", hash_at(F.col("left"), F.col("right"), "rep", scheme))


def hot_buckets(slim: DataFrame, hot_rows: int) -> DataFrame | None:
    """(rep, hash, parts) of the buckets of more than hot_rows rows: how many groups each is cut into; None where there is none.

    Counting combines in the map tasks, so it moves a row a bucket, not a row a row.
    """
    large = slim.groupBy("rep", "hash").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    large = cut(large.select("rep", "hash", F.ceil(F.col("n") / hot_rows).cast("int").alias("parts")))
    return None if large.isEmpty() else large


def salted(slim: DataFrame, hot: DataFrame | None) -> DataFrame:
    """slim with parts and the group g of each row within its bucket."""
    if hot is None:
        return slim.withColumn("parts", F.lit(1)).withColumn("g", F.lit(0))
    return slim.join(hot, ["rep", "hash"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("g", F.pmod(F.xxhash64("id"), "parts").cast("int"))


def bucket_cells(hashed: DataFrame, hasher: Hasher, threshold: float, limit: int, hot_rows: int) -> DataFrame:
    """(id_l, id_r): pairs that collide at both levels and pass the tests. Each task solves its outer buckets, or cells of hot ones, together: the inner repetitions run over all of them at once, and no pair leaves that doesn't collide in both."""
    scheme, inner = hasher.scheme, hasher.inner
    slim = exploded(hashed, hasher)
    hot = hot_buckets(slim, hot_rows)
    placed = salted(slim, hot)
    cells = placed.withColumn("cell", F.explode(cell_array(F.col("g"), F.col("parts")))) if hot is not None else placed.withColumn("cell", F.struct(F.lit(0).alias("cell_i"), F.lit(0).alias("cell_j"), F.lit(BOTH).alias("side")))
    columns = ["id", "left", "right", "left2", "right2", "sketch", "size", "bitmap"]
    cells = cells.select("rep", "hash", "cell.cell_i", "cell.cell_j", "cell.side", *columns)
    slots = hashed.sparkSession.sparkContext.defaultParallelism
    tasks = max(2 * slots, -(-hashed.count() * scheme.repetitions // TASK_ROWS))
    kind = dict(hashed.dtypes)["id"]
    # Where a bucket's pairs are fewer than what the inner repetitions list, all of them are tested instead.
    every = inner.repetitions * 4 >= 2**inner.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        side, rep = table["side"].to_numpy(), table["rep"].to_numpy()
        keys = np.stack([rep.astype(np.int64), table["hash"].to_numpy().astype(np.int64), table["cell_i"].to_numpy().astype(np.int64), table["cell_j"].to_numpy().astype(np.int64)], 1)
        _, cell = np.unique(keys, axis=0, return_inverse=True)
        cell = cell.ravel()
        for pick, partner, diagonal in ((BOTH, BOTH, True), (RIGHT, LEFT, False)):
            a, b = (np.flatnonzero(side == s) for s in (pick, partner))
            if not len(a) or not len(b):
                continue
            left, right = (table.take(pa.array(x)) for x in (a, b))
            l = slim_columns(left, hasher)
            r, own_rep = l if diagonal else slim_columns(right, hasher), rep[a]
            for rep2 in [None] if every else range(inner.repetitions):
                x, y = (cell[s] if rep2 is None else cell[s] << inner.k | hash_of(h, rep2, inner, "2") for s, h in ((a, l), (b, r)))
                for i, j in bucket_pairs(x, y, diagonal):
                    i, j = passing(l, r, i, j, hasher, limit, threshold)
                    first = meeting(l, r, i, j, inner, "2")
                    ok = first < inner.repetitions if rep2 is None else first == rep2
                    i, j = i[ok], j[ok]
                    ok = meeting(l, r, i, j, scheme) == own_rep[i]
                    yield from pair_table(left["id"], right["id"], i[ok], j[ok], None, left.schema.field("id").type).to_batches()

    return cells.repartition(tasks, "rep", "hash", "cell_i", "cell_j").mapInArrow(run, f"id_l {kind}, id_r {kind}")


def candidates(hashed: DataFrame, hasher: Hasher, with_self: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of the bucket join with their flags: rep (rep2), id_l, id_r, the bits that differ, and first, the first repetition of a collision.

    The join is on (rep, hash), or on both levels' repetitions and hashes; vectors take no part in it. A bucket of more than
    hot_rows rows is cut into groups: a left row meets each group of the right ones under a key of its own.
    """
    scheme, inner = hasher.scheme, hasher.inner
    slim = exploded(hashed, hasher)
    hot = hot_buckets(slim, hot_rows)
    keys, pools = ["rep", "hash"], {"": scheme}
    if inner:
        slim = slim.withColumn("rep2", F.explode(F.sequence(F.lit(0), F.lit(inner.repetitions - 1)))).withColumn("hash2", hash_at(F.col("left2"), F.col("right2"), "rep2", inner))
        keys, pools = [*keys, "rep2", "hash2"], {"": scheme, "2": inner}
    left = right = slim
    if hot is not None:
        placed, every = salted(slim, hot), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        left, right = placed.withColumn("g_l", F.col("g")).withColumn("g_r", every), placed.withColumn("g_r", F.col("g")).withColumn("g_l", every)
        keys = [*keys, "g_l", "g_r"]
    l, r = bucket_side(left, keys, pools, "l"), bucket_side(right, keys, pools, "r")
    order = F.col("id_l") <= F.col("id_r") if with_self else F.col("id_l") < F.col("id_r")
    # Statistics do not see how far the repetitions multiply the rows: never broadcast a side.
    joined = l.hint("merge").join(r, keys).where(order)
    return joined.withColumn("first", first_only(pools)).withColumn("bits", sketch_distance(hasher))


def bucket_side(slim: DataFrame, keys: list, pools: dict[str, Tensor], s: str) -> DataFrame:
    """One side of a bucket join. The left one keeps of its pools only what precedes the repetition, so that the test for a first collision needs no repetition."""
    out = [F.col(c).alias(f"{c}_{s}") for c in ("id", "sketch", "size", "bitmap")]
    for level, scheme in pools.items():
        for name, i in (("left", f"CAST(rep{level} DIV {scheme.hashers} AS INT)"), ("right", f"CAST(rep{level} % {scheme.hashers} AS INT)")):
            pool = F.col(name + level)
            words = prefix_words(pool, F.expr(i), scheme.hashers) if s == "l" else [pool.getItem(w) for w in range(words_of(scheme.hashers))]
            out += [w.alias(f"{name}{level}_{s}{k}") for k, w in enumerate(words)]
    return slim.select(*keys, *out)


def first_only(pools: dict[str, Tensor]) -> Column:
    tests = [
        none_equal([F.col(f"{name}{level}_l{w}") for w in range(words_of(scheme.hashers))], [F.col(f"{name}{level}_r{w}") for w in range(words_of(scheme.hashers))])
        for level, scheme in pools.items()
        for name in ("left", "right")
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def sketch_distance(hasher: Hasher) -> Column:
    return different_bits(F.col("sketch_l"), F.col("sketch_r"), hasher.sketch_bits // 64) if hasher.sketch_bits else F.lit(0)


def near_sizes(hasher: Hasher, threshold: float) -> Column:
    """Whether sizes and bitmaps allow the similarity; always true of vectors."""
    if not hasher.bitmap_words:
        return F.lit(True)
    a, b = F.col("size_l"), F.col("size_r")
    return length_filter(a, b, threshold) & (different_bits(F.col("bitmap_l"), F.col("bitmap_r"), hasher.bitmap_words) <= (a + b) * F.lit((1 - threshold) / (1 + threshold)) + 1e-9)


def surviving_pairs(hashed: DataFrame, hasher: Hasher, limit: int, threshold: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id_l, id_r): pairs that collide (at both levels, if there are two) and that sizes, bitmaps and sketches don't rule out, each once."""
    hashed = cut(hashed)
    if hasher.inner:
        return bucket_cells(hashed, hasher, threshold, limit, hot_rows)
    return candidates(hashed, hasher, hot_rows=hot_rows).where(near_sizes(hasher, threshold) & (F.col("bits") <= limit) & F.col("first")).select("id_l", "id_r")


def verify(pairs: DataFrame, rows: DataFrame, measure: str, dim: int) -> DataFrame:
    """(id_l, id_r, similarity, and pairs' other columns): values join to the pairs that are left; sets are compared in the JVM, vectors a batch at a time."""
    extra = [c for c in pairs.columns if c not in ("id_l", "id_r")]
    both = pairs.join(rows.select(F.col("id").alias("id_l"), F.col("v").alias("v_l")), "id_l").join(rows.select(F.col("id").alias("id_r"), F.col("v").alias("v_r")), "id_r")
    both = both.select("id_l", "id_r", "v_l", "v_r", *extra)
    if measure != COSINE:
        return both.select("id_l", "id_r", jaccard(F.col("v_l"), F.col("v_r")).alias("similarity"), *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sim = pa.array(row_similarities(measure, b.column(2), b.column(3), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sim, *(b.column(4 + k) for k in range(len(extra)))], names=["id_l", "id_r", "similarity", *extra])

    kinds = dict(both.dtypes)
    return both.mapInArrow(run, f"id_l {kinds['id_l']}, id_r {kinds['id_r']}, similarity double" + "".join(f", {c} {kinds[c]}" for c in extra))


def make_hasher(measure: str, dim: int, threshold: float, k: int, k2: int | None, recall: float, seed: int, sketch_bits: int, per_token: int = BITS_PER_TOKEN) -> Hasher:
    """dim: of vectors; of sets their mean size, which the bitmaps follow with so many bits per token."""
    if sketch_bits not in (0, 64, 128, 256, 512):
        raise ValueError("sketch_bits must be 0, 64, 128, 256 or 512")
    words = 0 if measure == COSINE else bitmap_words(dim, per_token)
    scheme, inner = (tensor(measure, threshold, k, recall), None) if k2 is None else two_level(measure, threshold, k, k2, recall)
    return Hasher(measure, scheme, seed, dim, inner, sketch_bits, words)


def bitmap_words(size: int, per_token: int) -> int:
    """Words of a bitmap with about so many bits for each token of a set of this size; a power of two from 1 to 64."""
    return min(64, max(1, 1 << math.ceil(math.log2(max(1, per_token * size / 64)))))


def similarity_self_join(
    df: DataFrame, id_col: str, value_col: str, threshold: float, algorithm: str = "cartesian", k: int = 8, k2: int = 6,
    recall: float = 0.8, seed: int = 14598, sketch_bits: int = 0, sketch_epsilon: float = 0.01, dry_run: bool = False, groups: int | None = None,
    unit: bool = False, hot_rows: int = HOT_ROWS, blocks: bool | None = None,
) -> DataFrame:
    """The pairs (id_l, id_r, similarity). unit: vectors are divided by their norms first; else they must have norm 1 for their products to be cosines.

    With dry_run, for one-level and two-level hashing: the pairs that collide, a row for each repetition, unverified.
    blocks: whether hashing compares all pairs and keeps those that collide, or lists those that collide; the result is the same, and unless given what costs less is done.
    """
    if algorithm not in ("cartesian", "local-lsh", "one-level-lsh", "two-level-lsh"):
        raise ValueError(f"no algorithm {algorithm}")
    if dry_run and algorithm in ("cartesian", "local-lsh"):
        raise ValueError(f"{algorithm} has no dry run: it lists no pairs before it verifies them")
    from affinis.operators.setjoin import set_pairs

    rows, measure, dim = items(df, id_col, value_col, unit)
    if algorithm == "cartesian":
        if measure != COSINE and threshold >= RARE_PAYS:
            return set_pairs(rows, threshold, groups)
        words = 0 if measure == COSINE else bitmap_words(dim, 2 * BITS_PER_TOKEN)
        slim = rows if measure == COSINE else with_bitmaps(rows, words)
        return cartesian(slim, measure, dim, threshold, groups or group_count(rows, 64 + 8 * words + (value_bytes(rows, dim) if measure == COSINE else 8 * dim)), words)
    hasher = make_hasher(measure, dim, threshold, k, k2 if algorithm == "two-level-lsh" else None, recall, seed, sketch_bits, BITS_PER_TOKEN * (1 + (algorithm == "local-lsh")))
    limit = sketch_threshold(measure, sketch_bits, threshold, sketch_epsilon)
    if measure == COSINE and not dry_run and (blocks_pay(hasher) if blocks is None else blocks):
        return hashed_cells(rows, hasher, threshold, limit, groups or group_count(rows, row_bytes(hasher, value_bytes(rows, dim))))
    if measure != COSINE and threshold >= RARE_PAYS and not dry_run and (scheme_lists_many(hasher) if blocks is None else blocks):
        return set_pairs(rows, threshold, groups, replace(hasher, bitmap_words=0), limit)
    if algorithm == "local-lsh":
        return local_lsh(rows, hasher, threshold, limit, groups)
    hashed = hasher.add(rows)
    if dry_run:
        return candidates(hashed, hasher, hot_rows=hot_rows).select("id_l", "id_r", "rep", *(["rep2"] if hasher.inner else []))
    return verify(surviving_pairs(hashed, hasher, limit, threshold, hot_rows), rows, measure, dim).where(F.col("similarity") >= threshold - 1e-12)


def with_bitmaps(rows: DataFrame, words: int) -> DataFrame:
    """(id, v, size, bitmap)"""
    from affinis.functions.families import as_lists, bitmaps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.diff(np.asarray(b.column(1).offsets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), as_lists(bitmaps(b.column(1), words), pa.int64())], names=["id", "v", "size", "bitmap"])

    kinds = dict(rows.dtypes)
    return rows.select("id", "v").mapInArrow(run, f"id {kinds['id']}, v array<bigint>, size int, bitmap array<bigint>")


def near_folded(df: DataFrame, id_col: str, value_col: str, threshold: float, fold: Callable[[Iterator[tuple], pa.Table, pa.Table], Iterator[pa.Table]], schema: str, hasher: Callable[[int], Hasher] | None = None) -> DataFrame:
    """fold(blocks of near pairs (i, j, similarity), left rows, right rows) in each cell, so that the pairs themselves don't leave it. Vectors only; hasher, made of their dimension, hashes the rows first."""
    rows, measure, dim = items(df, id_col, value_col)
    if measure != COSINE:
        raise TypeError("pairs are folded for vectors only")
    made = hasher(dim) if hasher else None
    value = value_bytes(rows, dim)
    groups = group_count(rows, row_bytes(made, value) if made else 64 + value)
    solve = lambda left, right, diagonal: fold(near_vectors(matrix(left, dim), matrix(right, dim), threshold, diagonal), left, right)
    return per_cell(made.add(rows, keep_value=True) if made else rows, groups, solve, schema)


def first_matches(df: DataFrame, id_col: str, value_col: str, threshold: float, n: int) -> DataFrame:
    """At most n partners of each row, the most similar first, ties by id."""
    from pyspark.sql import Window

    if measure_of(df, value_col) == COSINE:
        kind = dict(df.dtypes)[id_col]
        both = near_folded(df, id_col, value_col, threshold, lambda found, left, right: best_partners(found, left["id"], right["id"], n), f"id_l {kind}, id_r {kind}, similarity double")
    else:
        pairs = similarity_self_join(df, id_col, value_col, threshold)
        both = pairs.unionByName(pairs.select(F.col("id_r").alias("id_l"), F.col("id_l").alias("id_r"), "similarity"))
    at = Window.partitionBy("id_l").orderBy(F.desc("similarity"), "id_r")
    return both.withColumn("n", F.row_number().over(at)).where(F.col("n") <= n)


def best_partners(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], ids_l: pa.ChunkedArray, ids_r: pa.ChunkedArray, n: int, most: int = 4 * PAIRS) -> Iterator[pa.Table]:
    """(id_l, id_r, similarity) of a cell's n best partners of each row, in both directions; no more pairs than about so many are kept at a time."""
    ids = np.concatenate([ids_l.to_numpy(), ids_r.to_numpy()])
    rank = np.unique(ids, return_inverse=True)[1]
    kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    waiting, count = [], 0

    def reduced() -> list[np.ndarray]:
        owner, partner, sim = (np.concatenate(x) for x in zip(kept, *waiting, strict=True))
        order = np.lexsort((rank[partner], -sim, rank[owner]))
        own = rank[owner[order]]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        place = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
        order = order[place < n]
        return [owner[order], partner[order], sim[order]]

    for i, j, sim in found:
        j = j + len(ids_l)
        waiting += [(i, j, sim), (j, i, sim)]
        count += 2 * len(i)
        if count > most:
            kept, waiting, count = reduced(), [], 0
    owner, partner, sim = reduced()
    kind = ids_l.type
    yield pa.table({"id_l": pa.array(ids[owner], kind), "id_r": pa.array(ids[partner], kind), "similarity": sim})


def bucket_self_join(df: DataFrame, keys: list[str], function: Callable[[tuple, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run function(key, rows) on each bucket of equal keys."""
    return df.groupBy(*keys).applyInArrow(function, schema)


def equi_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join of two inputs."""
    return left.join(right, keys)


__all__ = ["Tensor", "bucket_self_join", "candidates", "cartesian", "equi_join", "first_matches", "local_lsh", "near_folded", "sequential", "similarity_self_join", "verify"]
