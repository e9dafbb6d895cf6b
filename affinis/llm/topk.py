"""Exact nearest neighbours of a set of query rows among all rows, by pivot-table elimination.

Each vector's distances to PIVOTS pivots are computed once. By the triangle inequality the largest
difference of two rows' entries is a lower bound of their distance. Rows are cut into blocks of near rows (by nearest pivot).
First each query searches its own block, which gives an upper bound of its k-th distance; then it visits only
the blocks whose per-pivot ranges allow a nearer row. Within a block the candidates are evaluated in the order of their
bounds, in parts that double; each part lowers the k-th distance, and the evaluation stops at the first
candidate whose bound exceeds it. Nothing else ends it and nothing replaces it, so the result is exact;
``evaluations`` tells how many distances that took. Where bounds say little (vectors without clusters), that is nearly all of them.

The blocks' ranges stay distributed: queries meet them in chunks of CHUNK blocks. A block that many queries visit is
copied to several tasks, a part of the queries each.

Defined cases: rows with a null id, and vectors that are null, hold a null, NaN or infinite number, or whose
dimension is not the most frequent one (of equals: the smaller), take no part; rows that repeat an id count once,
with the least of their vectors; equal distances go to the smaller id; with fewer than k others a row has fewer
neighbours; an empty table, or one without a query, gives no rows; other columns are not read; ids may be numbers or strings.
Distances are Euclidean, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.llm.common import col, cut, table

K, PIVOTS, BLOCK_ROWS = 10, 24, 8192
#: Rows among which pivots are chosen; the choice affects speed only.
PIVOT_SAMPLE = 1024
#: Allowance for rounding in bounds, as a share of the largest distance to a pivot.
SLACK = 1e-9
#: Candidates of the first part that a query evaluates.
PART = 64
#: Blocks whose ranges one task holds, queries that one task matches with them, and queries that one task runs through a block.
CHUNK, CHUNK_QUERIES, BLOCK_QUERIES = 65536, 16384, 4096
#: Queries of the registered query: rows whose id is divisible by this, against all rows.
EVERY = 50


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    chosen = [0]
    far = np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def apart(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of q from the rows of x."""
    gap = x - q
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def search(q: np.ndarray, q_table: np.ndarray, own: np.ndarray, limit: float, x: np.ndarray, x_table: np.ndarray, k: int, part: int = PART) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of x, sorted by id, that are the k nearest to q and no further than the limit; their distances; and how many distances were computed.

    x_table: (pivots, rows). own: rows that don't count.
    """
    slack = SLACK * (1 + float(np.abs(q_table).max(initial=0)) + float(np.abs(x_table).max(initial=0)))
    bound = np.abs(x_table - q_table[:, None]).max(0)
    bound[own] = np.inf
    rows = np.flatnonzero(bound <= min(limit + slack, np.finfo(np.float64).max))
    rows = rows[np.argsort(bound[rows], kind="stable")]
    bound = bound[rows]
    best, at, done = limit, np.zeros(0, np.int64), 0
    far = np.zeros(0)
    while done < len(rows):
        stop = min(done + part, int(np.searchsorted(bound, best + slack, side="right")))
        if stop <= done:
            break
        at, far = np.append(at, rows[done:stop]), np.append(far, apart(q, x[rows[done:stop]]))
        order = np.lexsort((at, far))[:k]
        at, far, done, part = at[order], far[order], stop, 2 * part
        if len(far) == k:
            best = min(best, float(far[-1]))
    keep = far <= limit
    return at[keep], far[keep], done


def matrix(arr: pa.Array, dim: int) -> np.ndarray:
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of batches with equal values in their first columns, which are numbers."""
    for b in batches:
        if b.num_rows:
            key = np.stack([b.column(i).to_numpy() for i in range(keys)], 1)
            cuts = (np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                yield tuple(key[lo].tolist()), b.slice(lo, hi - lo)


def found(rows: DataFrame, k: int, pivots: int, block_rows: int, chunk: int = CHUNK, block_queries: int = BLOCK_QUERIES) -> DataFrame | None:
    """(id, n, d, evaluated): candidates that contain the k nearest of each query, and, with a null n, the distances computed. rows: (id, v, query)."""
    spark = rows.sparkSession
    slots = spark.sparkContext.defaultParallelism
    v, c = F.col("v"), F.col
    rows = rows.where(c("id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sizes = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return None
    dim, kind = sizes[0]["n"], dict(rows.dtypes)["id"]
    rows = cut(rows.where(F.size(v) == dim).groupBy("id").agg(F.min("v").alias("v"), F.max("query").alias("query")))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).toArrow()
    pivot = farthest_first(matrix(sample["v"].combine_chunks(), dim), pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            t = np.stack([apart(p, x) for p in pivot], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists(t), pa.array(t.argmin(1))], names=["id", "v", "query", "t", "near"])

    measured = cut(rows.mapInArrow(measure, f"id {kind}, v array<double>, query boolean, t array<double>, near bigint"))
    split = measured.groupBy("near").agg(F.ceil(F.count("*") / block_rows).cast("bigint").alias("parts")).withColumn("base", F.sum("parts").over(Window.orderBy("near")) - c("parts"))  # one row a pivot
    placed = cut(measured.join(F.broadcast(split), "near").select("id", "v", "t", "query", (c("base") + F.pmod(F.xxhash64("id"), c("parts"))).alias("block")))
    blocks = int(split.agg(F.sum("parts")).first()[0])

    def visits(asks: DataFrame) -> DataFrame:
        """asks: (block, id, v, t, lim)."""
        # A block's copies: enough for the queries that visit it, and for the slots where blocks are few.
        parts = asks.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / block_queries), F.lit(-(-2 * slots // blocks))).cast("int").alias("parts"))
        data = placed.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), c("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "id", "v", "t", F.lit(None).cast("double").alias("lim"))
        both = data.unionByName(asks.join(parts, "block").select("block", F.pmod(F.xxhash64("id"), c("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "id", "v", "t", "lim"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come sorted by block, part and kind: a block's data, then the queries that visit it."""
            here, held, ids, x, t = None, [], None, None, None
            for (block, part, is_query), some in runs(batches, 3):
                if not is_query:
                    if (block, part) != here:
                        here, held = (block, part), []
                    held.append(some)
                    x = None
                    continue
                if x is None:
                    all_ = pa.Table.from_batches(held).sort_by("id").combine_chunks()
                    ids, x, t = all_["id"].combine_chunks(), matrix(all_["v"].combine_chunks(), dim), np.ascontiguousarray(matrix(all_["t"].combine_chunks(), len(pivot)).T)
                    where = ids.to_numpy(zero_copy_only=False)
                q, q_t, limit, q_ids = matrix(some.column(4), dim), matrix(some.column(5), len(pivot)), some.column(6).to_numpy(), some.column(3).to_numpy(zero_copy_only=False)
                got = [search(q[i], q_t[i], np.flatnonzero(where == q_ids[i]), limit[i], x, t, k) for i in range(len(q))]
                each = np.array([len(g[0]) for g in got])
                owner = pa.array(np.append(np.repeat(np.arange(len(q)), each), np.arange(len(q))))
                at = pa.array(np.concatenate([g[0] for g in got] + [np.zeros(len(q), np.int64)]), mask=np.arange(len(owner)) >= each.sum())
                d = pa.array(np.concatenate([g[1] for g in got] + [np.zeros(len(q))]))
                n = pa.array(np.append(np.zeros(int(each.sum()), np.int64), [g[2] for g in got]))
                yield pa.RecordBatch.from_arrays([some.column(3).take(owner), ids.take(at), d, n], names=["id", "n", "d", "evaluated"])

        tasks = max(2 * slots, blocks)
        return both.repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(run, f"id {kind}, n {kind}, d double, evaluated bigint")

    queries = placed.where("query")
    home = cut(visits(queries.select("block", "id", "v", "t", F.lit(float("inf")).alias("lim"))))
    limits = home.where("n IS NOT NULL").groupBy("id").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("lim"))
    limited = queries.join(limits, "id", "left").select("id", "v", "t", F.coalesce("lim", F.lit(float("inf"))).alias("lim"), c("block").alias("home"))

    # The queries against the blocks' ranges, chunk by chunk.
    chunks = -(-blocks // chunk)
    shards = max(1, -(-queries.count() // CHUNK_QUERIES))
    ranges = [F.array(*(f(c("t")[p]) for p in range(len(pivot)))).alias(name) for name, f in (("lo", F.min), ("hi", F.max))]
    numbers = [F.lit(None).cast(x).alias(name) for name, x in (("lim", "double"), ("home", "bigint"))]
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    summary = placed.groupBy("block").agg(*ranges).select(F.pmod("block", F.lit(chunks)).cast("int").alias("chunk"), spread(shards).alias("shard"), F.lit(0).alias("kind"), "block", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("array<double>").alias("v"), c("lo").alias("t"), "hi", *numbers)
    asks = limited.select(spread(chunks).alias("chunk"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), F.lit(-1).cast("bigint").alias("block"), "id", "v", "t", F.lit(None).cast("array<double>").alias("hi"), "lim", "home")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, block, lo, hi = None, [], None, None, None
        for (chunk_, shard, is_query), some in runs(batches, 3):
            if not is_query:
                if (chunk_, shard) != here:
                    here, held = (chunk_, shard), []
                held.append(some)
                block = None
                continue
            if block is None:
                all_ = pa.Table.from_batches(held).combine_chunks()
                block, lo, hi = all_["block"].to_numpy(), *(np.ascontiguousarray(matrix(all_[name].combine_chunks(), len(pivot)).T) for name in ("t", "hi"))
            t, limit, home_ = matrix(some.column(6), len(pivot)), some.column(8).to_numpy(), some.column(9).to_numpy()
            slack = SLACK * (1 + float(hi.max(initial=0)) + float(t.max(initial=0)))
            go = [np.flatnonzero((np.maximum(lo - t[i][:, None], t[i][:, None] - hi).max(0) <= limit[i] + slack) & (block != home_[i])) for i in range(len(t))]
            for i in range(0, len(go), 256):
                owner = pa.array(np.repeat(np.arange(i, min(i + 256, len(go))), [len(g) for g in go[i : i + 256]]))
                yield pa.RecordBatch.from_arrays([pa.array(block[np.concatenate(go[i : i + 256])]), *(some.column(x).take(owner) for x in (4, 5, 6, 8))], names=["block", "id", "v", "t", "lim"])

    both = summary.unionByName(asks).repartition(max(slots, chunks * shards), "chunk", "shard").sortWithinPartitions("chunk", "shard", "kind")
    more = cut(both.mapInArrow(match, f"block bigint, id {kind}, v array<double>, t array<double>, lim double"))
    return home.unionByName(visits(more))


def searched(df: DataFrame, queries: Column | None, id_col: str, vec_col: str) -> DataFrame:
    return df.select(col(id_col).alias("id"), col(vec_col).cast("array<double>").alias("v"), F.lit(True).alias("query") if queries is None else F.coalesce(queries, F.lit(False)).alias("query"))


def neighbours(df: DataFrame, k: int = K, queries: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, **options) -> DataFrame:
    """(id, rank, neighbour, distance): the k nearest other rows of each row for which ``queries`` holds (all, if it isn't given), rank from 1."""
    kind = dict(df.dtypes)[id_col]
    got = found(searched(df, queries, id_col, vec_col), k, pivots, block_rows, **options)
    if got is None:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, rank int, neighbour {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "n"))
    best = got.where("n IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(F.col("id").alias(id_col), "rank", F.col("n").alias("neighbour"), F.col("d").alias("distance"))


def evaluations(df: DataFrame, k: int = K, queries: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, **options) -> DataFrame:
    """(id, evaluated): how many distances each query's search computed."""
    got = found(searched(df, queries, id_col, vec_col), k, pivots, block_rows, **options)
    if got is None:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {dict(df.dtypes)[id_col]}, evaluated bigint")
    return got.where("n IS NULL").groupBy(F.col("id").alias(id_col)).agg(F.sum("evaluated").alias("evaluated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows. Distances to 6 digits, so that engines that sum in another order agree."""
    return neighbours(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % EVERY == 0).withColumn("distance", F.round("distance", 6))


SQL = f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS n FROM p)
SELECT vec_id, CAST(n AS INTEGER) AS rank, neighbour, round(d, 6) AS distance FROM r WHERE n <= {K}
"""
