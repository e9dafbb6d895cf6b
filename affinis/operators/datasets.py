"""Preparation of datasets: text to token sets, encoding, sampling, inflation, diversification, synthetic data."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.functions.measures import let
from affinis.sources.io import cut


def whitespace_tokens(text: Column, separator: str = "[ \\t\\n\\r]+", upper: bool = False) -> Column:
    parts = F.split(F.upper(text) if upper else text, separator)
    return F.filter(parts, lambda x: x != "")


def alphanumeric_tokens(text: Column, upper: bool = False) -> Column:
    return whitespace_tokens(text, "[^0-9A-Za-z]+", upper)


def qgrams(text: Column, q: int, pad: str = "#") -> Column:
    """All substrings of q characters of the text padded by q - 1 signs on both ends."""
    none = F.array().cast("array<string>")

    def cut(t: Column) -> Column:
        last = F.length(t) - (q - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(t, i, F.lit(q)))).otherwise(none)

    return let(F.concat(F.lit(pad * (q - 1)), text, F.lit(pad * (q - 1))), cut)


def shingles(words: Column, n: int, pad: str = "#") -> Column:
    """All runs of n words, padded by n - 1 signs on both ends, joined by spaces."""
    ends = F.array(*[F.lit(pad)] * (n - 1))
    none = F.array().cast("array<string>")

    def cut(w: Column) -> Column:
        last = F.size(w) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(none)

    return let(F.concat(ends, words, ends) if n > 1 else words, cut)


def hashed_tokens(words: Column) -> Column:
    """Token ids below 2^60 from a digest, the same in every engine; no dictionary. Two of n words share an id with a chance of n^2 / 2^61."""
    return F.sort_array(F.array_distinct(F.transform(F.array_distinct(words), lambda w: F.conv(F.substring(F.md5(w), 1, 15), 16, 10).cast("bigint"))))


def encode_multisets(df: DataFrame, id_col: str, words: Column, drop_repeats: bool = False) -> DataFrame:
    """(id, token, occurrence): a token's identity is the word and how many times it has occurred in its row; or each word once."""
    exploded = df.select(F.col(id_col).alias("id"), F.posexplode(F.array_distinct(words) if drop_repeats else words).alias("place", "token"))
    at = Window.partitionBy("id", "token").orderBy("place")
    return exploded.select("id", "token", F.row_number().over(at).alias("occurrence"))


def dictionary(tokens: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, df, code): codes from 1 by ascending document frequency, ties by key. Ranks are made within range partitions, so no task sorts all tokens, nor all those of one frequency."""
    keys = keys or ["token"]
    counts = tokens.groupBy(*keys).agg(F.count_distinct("id").alias("df"))
    return renumber(counts, ["df", *keys], "code").select(*keys, "df", (F.col("code") + 1).alias("code"))


def encode_sets(df: DataFrame, id_col: str, words: Column, drop_repeats: bool = False) -> DataFrame:
    """(id, words): sorted token codes, rare tokens first."""
    tokens = encode_multisets(df, id_col, words, drop_repeats)
    keys = ["token", "occurrence"]
    return tokens.join(dictionary(tokens, keys), keys).groupBy("id").agg(F.array_sort(F.collect_list("code")).alias("words"))


def foreign_encode(df: DataFrame, id_col: str, words: Column, known: DataFrame) -> DataFrame:
    """(id, words) with the codes of another dataset's dictionary; an unknown token is 0."""
    tokens = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(words)).alias("token"))
    return tokens.join(known.select("token", "code"), "token", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.coalesce("code", F.lit(0)))).alias("words"))


def top_vocabulary(df: DataFrame, id_col: str, words: Column, size: int, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(token, n, code): the most frequent tokens, codes from 0; ties by token. The size is the feature."""
    tokens = df.select(F.explode(words).alias("token")).where(~F.col("token").isin(*stop_words) if stop_words else F.lit(True))
    top = tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(size)
    return top.withColumn("code", F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1)


def bag_of_words(df: DataFrame, id_col: str, words: Column, vocabulary: DataFrame) -> DataFrame:
    """(id, universe, words): the set of each row's vocabulary codes; rows without one are dropped."""
    tokens = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(words)).alias("token"))
    universe = vocabulary.agg(F.count("*").alias("universe"))
    sets = tokens.join(vocabulary.select("token", "code"), "token").groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("words"))
    return sets.crossJoin(F.broadcast(universe)).select("id", "universe", "words")  # universe: one row


def adjacency(df: DataFrame, key: str, value: str) -> DataFrame:
    """(id, words): the set of values of each key."""
    return df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set(value)).alias("words"))


def remap_tokens(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, words) through (token, code); a token without a code makes the row's words null."""
    tokens = df.select("id", F.explode("words").alias("token"))
    joined = tokens.join(mapping.select("token", "code"), "token", "left").groupBy("id")
    return joined.agg(F.when(F.count(F.when(F.col("code").isNull(), 1)) == 0, F.array_sort(F.collect_list("code"))).alias("words"))


def dedup_sets(df: DataFrame) -> DataFrame:
    """Of equal sets the one with the least id, with its size; order by (size, words) to list them as the sets sort."""
    return df.groupBy("words").agg(F.min("id").alias("id")).select("id", F.size("words").alias("size"), "words")


def shuffle_by_length(df: DataFrame, seed: int = 1) -> DataFrame:
    """Rows by size, in random order within a size."""
    return df.withColumn("r", F.rand(seed)).orderBy(F.size("words"), "r").drop("r")


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df with ``part``, the number of the range partition of the order that a row is in."""
    # Written before the ranges are sampled, and after: neither is done twice.
    return cut(cut(df).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def renumber(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Ids from 0 in the given order, without one task sorting all rows: ranks within range partitions plus the counts before."""
    return running(df, order, F.lit(1), name).withColumn(name, F.col(name) - 1)


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows up to each in the given order, range partition by range partition."""
    spread = ranged(df.withColumn("\x00value", value), order)
    sums = spread.groupBy("part").agg(F.sum("\x00value").alias("all"))
    base = sums.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))  # one row a partition
    own = F.sum("\x00value").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return spread.withColumn(name, own).join(base, "part").withColumn(name, F.col("base") + F.col(name)).drop("part", "base", "\x00value")


def carried(df: DataFrame, order: list[str], value: str, name: str, include: bool) -> DataFrame:
    """df with the last value that isn't null of the rows before each in the given order (include: up to it), range partition by range partition; the name of a partition's last value is its own."""
    spread = ranged(df, order)
    last = spread.where(F.col(value).isNotNull()).groupBy("part").agg(F.max_by(value, F.struct(*order)).alias("end"))
    parts = spread.select("part").distinct().join(last, "part", "left")
    before = parts.select("part", F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("base"))  # one row a partition
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include else -1))
    return spread.withColumn(name, own).join(before, "part").withColumn(name, F.coalesce(name, "base")).drop("part", "base")


def sample_dataset(df: DataFrame, size: int, seed: int = 1234, total: int | None = None) -> DataFrame:
    """Bernoulli sample of the expected size."""
    return df.sample(min(1.0, size / max(1, total if total is not None else df.count())), seed)


def hash_sample(df: DataFrame, id_col: str, share: float) -> DataFrame:
    """Rows whose id's digest falls below the share; the same in every engine."""
    return df.where(F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 7), 16, 10).cast("bigint") < F.lit(int(share * 2**28)))


def inflate_sets(df: DataFrame, factor: int) -> DataFrame:
    """factor copies of (id, universe, words); copy i has its tokens shifted by i modulo the universe; ids id * factor + i."""
    copies = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    return copies.select((F.col("id") * factor + F.col("i")).alias("id"), "universe", F.transform("words", lambda w: w + F.expr("i % universe")).alias("words"))


def inflate_vectors(df: DataFrame, factor: int, dim: int, seed: int = 1) -> DataFrame:
    """factor copies of (id, v), each through its own random Gaussian matrix, made unit vectors again."""
    rng = np.random.default_rng(seed)
    matrices = rng.standard_normal((factor, dim, dim)) / math.sqrt(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            for i in range(factor):
                y = x @ matrices[i]
                n = np.linalg.norm(y, axis=1, keepdims=True)
                y /= np.where(n > 0, n, 1)
                yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy() * factor + i), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * dim, pa.int32()), pa.array(y.ravel()))], names=["id", "v"])

    return df.select(F.col("id").cast("bigint"), F.col("v").cast("array<double>")).mapInArrow(run, "id bigint, v array<double>")


def perturb_vectors(df: DataFrame, sigma: float = 0.01, seed: int = 1) -> DataFrame:
    """Gaussian noise on every coordinate."""
    return df.withColumn("v", F.transform("v", lambda x: x + F.randn(seed) * sigma))


def perturb_sets(df: DataFrame, rate: float = 1.0, seed: int = 1) -> DataFrame:
    """(id, universe, words) with as many more random tokens as an exponential draw, rounded down, of this rate; drawn from seed and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = []
            for i, universe, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rng = np.random.default_rng([seed, i])
                words.append(sorted({*own, *rng.integers(0, universe, int(rng.exponential(1 / rate))).tolist()}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.int64()))], names=["id", "universe", "words"])

    return df.select(F.col("id").cast("bigint"), F.col("universe").cast("bigint"), F.col("words").cast("array<bigint>")).mapInArrow(run, "id bigint, universe bigint, words array<bigint>")


def attach_difficulty(df: DataFrame, difficulty: DataFrame, at: float) -> DataFrame:
    """df with ``value``: the difficulty of its id for one range."""
    return df.join(difficulty.where(F.col("range") == at).select("id", "value"), "id")


def diversity_weights(difficulty: DataFrame) -> DataFrame:
    """(id, value, weight): the gap to the previous distinct difficulty, shared among the points with this one; weights sum to 1."""
    runs = difficulty.groupBy("value").agg(F.count("*").alias("n"))
    gaps = carried(runs.where("value IS NOT NULL"), ["value"], "value", "before", include=False).select("value", "n", (F.col("value") - F.coalesce("before", F.lit(0.0))).alias("gap"))
    total = gaps.agg(F.sum("gap").alias("all"))
    weighted = gaps.crossJoin(F.broadcast(total)).select("value", F.try_divide(F.col("gap"), F.col("n") * F.col("all")).alias("weight"))  # total: one row
    return difficulty.join(weighted, "value").select("id", "value", "weight")


def diversity_intervals(difficulty: DataFrame) -> DataFrame:
    """(id, lo, hi): weights as disjoint intervals of 0 to 1, by difficulty and id."""
    edges = running(diversity_weights(difficulty).where("weight > 0"), ["value", "id"], F.col("weight"), "hi")
    return edges.select("id", (F.col("hi") - F.col("weight")).alias("lo"), "hi")


def diversify_random(difficulty: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """(draw, id): a weighted sample with replacement of ids.

    Draws and intervals are sorted together by place; a draw takes the last interval that begins at or before it.
    """
    edges = diversity_intervals(difficulty).select("lo", F.lit(0).alias("kind"), "id", F.lit(None).cast("bigint").alias("draw"))
    draws = difficulty.sparkSession.range(size).select(F.rand(seed).alias("lo"), F.lit(1).alias("kind"), F.lit(None).cast(dict(difficulty.dtypes)["id"]).alias("id"), F.col("id").alias("draw"))
    return carried(edges.unionByName(draws), ["lo", "kind"], "id", "taken", include=True).where("kind = 1 AND taken IS NOT NULL").select("draw", F.col("taken").alias("id"))


def diversify_extreme(difficulty: DataFrame, low: float, n_low: int, high: float, n_high: int) -> DataFrame:
    """(id, copy): ids with difficulty <= low cycled to n_low rows and those with difficulty >= high to n_high; 0 and infinite ones are skipped."""
    usable = difficulty.where((F.col("value") != 0) & (F.abs("value") != float("inf")) & ~F.isnan("value"))

    def cycle(part: DataFrame, n: int) -> DataFrame:
        ranked = renumber(part.select("id"), ["id"], "rank")
        ranked = ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("m"))))  # one row
        return ranked.where(F.col("rank") < n).withColumn("copy", F.explode(F.sequence(F.lit(0), F.expr(f"CAST(({n} - 1 - rank) DIV m AS INT)")))).select("id", "copy")

    return cycle(usable.where(F.col("value") <= low), n_low).unionByName(cycle(usable.where(F.col("value") >= high), n_high))


def random_vectors(spark: SparkSession, n: int, dim: int, seed: int = 1) -> DataFrame:
    """(id, v): unit vectors with normal coordinates, drawn from seed and id, whatever the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([np.random.default_rng([seed, i]).standard_normal(dim) for i in b.column(0).to_pylist()]) if b.num_rows else np.zeros((0, dim))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()))], names=["id", "v"])

    return spark.range(n).mapInArrow(run, "id bigint, v array<double>")


def random_sets(spark: SparkSession, n: int, universe: int, mean: float, seed: int = 1) -> DataFrame:
    """(id, universe, words): sizes Poisson, tokens uniform with repetition; empty sets are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = []
            for i in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, i])
                words.append(np.sort(rng.integers(0, universe, rng.poisson(mean))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([universe] * len(words), pa.int64()), pa.array(words, pa.list_(pa.int64()))], names=["id", "universe", "words"])

    return spark.range(n).mapInArrow(run, "id bigint, universe bigint, words array<bigint>").where(F.size("words") > 0)


def random_blobs(spark: SparkSession, n: int, dim: int, centres: int, spread: float = 0.1, seed: int = 1) -> DataFrame:
    """(id, label, v): points around random centres."""
    c = np.random.default_rng(seed).standard_normal((centres, dim))
    table = F.array(*(F.array(*map(F.lit, row.tolist())) for row in c))
    rows = spark.range(n).withColumn("label", (F.col("id") % centres).cast("int")).withColumn("c", F.element_at(table, F.col("label") + 1))
    return rows.select("id", "label", F.transform("c", lambda x: x + F.randn(seed) * spread).alias("v"))


def fourier_features(df: DataFrame, dim: int, out: int, gamma: float = 1.0, seed: int = 1) -> DataFrame:
    """(id, v): cosines and sines, interleaved and scaled by sqrt(2 / out), of random projections."""
    w = np.random.default_rng(seed).standard_normal((dim, out // 2)) * math.sqrt(2 * gamma)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) @ w
            y = np.stack([np.cos(z), np.sin(z)], 2).reshape(len(z), -1) * math.sqrt(2 / out)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))], names=["id", "v"])

    return df.select("id", F.col("v").cast("array<double>")).mapInArrow(run, f"id {dict(df.dtypes)['id']}, v array<double>")


def rescale_by_neighbours(df: DataFrame, k: int = 10, id_col: str = "id", value_col: str = "v") -> DataFrame:
    """(id, v): vectors divided by the mean Euclidean distance to their k nearest others, so that dense regions spread; unchanged where that is 0 or there are none."""
    from affinis.operators.stats import against, lists_of_rows

    kind = dict(df.dtypes)[id_col]
    v = df.select(F.col(id_col).alias("id"), F.col(value_col).cast("array<double>").alias("v"))
    # Products and norms give distances, block by block; of each block the k nearest matter.
    norms = v.select("id", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("q"))
    lifted = v.join(norms, "id").select("id", F.concat("v", F.array("q", F.lit(1.0))).alias("v"))
    flipped = v.join(norms, "id").select("id", F.concat(F.transform("v", lambda x: -2 * x), F.array(F.lit(1.0), "q")).alias("v"))

    def nearest(ids: pa.Array, square: np.ndarray, others: pa.Array, _: np.ndarray) -> pa.Table:
        d = np.sqrt(np.maximum(square, 0))
        d[ids.to_numpy(zero_copy_only=False)[:, None] == others.to_numpy(zero_copy_only=False)[None]] = np.inf
        m = min(k, d.shape[1])
        near = np.partition(d, m - 1, axis=1)[:, :m] if m else np.zeros((len(ids), 0))
        return pa.table({"id": ids, "d": lists_of_rows(near)})

    found = against(lifted, flipped, "id", "v", nearest, f"id {kind}, d array<double>").groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k).alias("d"))
    finite = F.filter("d", lambda x: x < float("inf"))
    mean = found.select("id", F.try_divide(F.aggregate(finite, F.lit(0.0), lambda s, x: s + x), F.size(finite).cast("double")).alias("mean"))
    return v.join(mean, "id", "left").select("id", F.when(F.col("mean") > 0, F.transform("v", lambda x: x / F.col("mean"))).otherwise(F.col("v")).alias("v"))


def unique_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of some columns; rows in which one is null or blank are left out."""
    usable = F.lit(True)
    for c in columns:
        usable = usable & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return df.where(usable).select(*columns).distinct()


#: Datasets derived from others: name -> (base, operation, its arguments).
DERIVED: dict[str, tuple[str, str, dict]] = {
    **{f"{{base}}-sample-{n}": ("{base}", "sample", {"size": n}) for n in (200_000, 400_000, 800_000)},
    **{f"{{base}}-inflated-{n}": ("{base}", "inflate", {"factor": n}) for n in (2, 5, 10)},
}


def derive(spark: SparkSession, root: str, name: str, chunks: int = 40, seed: int = 1234) -> str:
    """The folder of a dataset under root; one that DERIVED names is made from its base on first use."""
    from affinis.sources import io

    path = f"{root}/{name}"
    if io.exists(spark, path):
        return path
    for pattern, (_, operation, options) in DERIVED.items():
        suffix = pattern.removeprefix("{base}")
        if name.endswith(suffix):
            df = spark.read.parquet(derive(spark, root, name.removesuffix(suffix), chunks, seed))
            if operation == "sample":
                out = sample_dataset(df, options["size"], seed)
                io.write_dataset(out, path, chunks, ["id"] if "id" in out.columns else None)
                return path
            sets = io.content_type(df) == io.SETS
            dim = 0 if sets else len(df.select("v").first()["v"])
            out = inflate_sets(df, options["factor"]) if sets else inflate_vectors(df, options["factor"], dim, seed)
            io.write_dataset(out, path, chunks)
            return path
    raise FileNotFoundError(f"no dataset {name} under {root}, and nothing derives it")
