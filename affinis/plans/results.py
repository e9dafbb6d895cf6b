"""Queries over a store of runs, their counters, samples and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = "id bigint, date string, code_version string, params_sha string, seed bigint, threshold double, algorithm string, algorithm_version int, k int, k2 int, sketch_bits int, threads int, hosts string, sketch_epsilon double, required_recall double, no_dedup boolean, no_verify boolean, repetition_batch bigint, balance string, path string, total_time_ms bigint, output_size bigint, recall double, speedup double, profile_frequency int, dry_run boolean"
COUNTERS = "id bigint, kind string, step int, worker int, count bigint"
NETWORK = "id bigint, hostname string, interface string, transmitted bigint, received bigint"
SYSTEM = "id bigint, time double, hostname string, cpu_user double, cpu_system double, net_tx bigint, net_rx bigint, mem_total bigint, mem_used bigint"
PROFILE = "id bigint, hostname string, thread string, name string, frame_count bigint"
DATA_BYTES = "id bigint, hostname string, datastructures_bytes bigint"


def latest_versions(runs: DataFrame) -> DataFrame:
    return runs.groupBy("algorithm").agg(F.max("algorithm_version").alias("algorithm_version"))


def recent(runs: DataFrame) -> DataFrame:
    """Runs of each algorithm's latest version."""
    return runs.join(latest_versions(runs), ["algorithm", "algorithm_version"])


def latest_by(runs: DataFrame, config: list[str]) -> DataFrame:
    return runs.groupBy(*config).agg(F.max("algorithm_version").alias("algorithm_version"))


def worker_load(counters: DataFrame) -> DataFrame:
    return counters.where("kind = 'Load'").groupBy("id", "worker").agg(F.sum("count").alias("load"))


def max_load(counters: DataFrame) -> DataFrame:
    """(id, max_load): the most that one worker of a run received."""
    return worker_load(counters).groupBy("id").agg(F.max("load").alias("max_load"))


def counters_pivot(counters: DataFrame, by: list[str], kinds: list[str]) -> DataFrame:
    """Kinds as columns; naming them spares a job to find them."""
    wide = counters.groupBy(*by).pivot("kind", kinds).agg(F.sum("count"))
    return wide.select(*by, *(F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(k) for k in kinds))


def candidate_fraction(counters: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, fraction): compared pairs (candidates without self pairs) over all pairs; sizes: (id, n)."""
    wide = counters_pivot(counters, ["id"], ["CandidatePairs", "SelfPairsDiscarded"])
    n = F.col("n")
    return wide.join(sizes, "id", "left").select("id", F.try_divide(F.col("CandidatePairs") - F.col("SelfPairsDiscarded"), n * (n - 1) / 2).alias("fraction"))


def against_baseline(runs: DataFrame, by: list[str], exact: str = "cartesian") -> DataFrame:
    """runs with recall, speedup and lost pairs against the exact run of the same dataset and threshold."""
    base = runs.where(F.col("algorithm") == exact).groupBy(*by).agg(F.max("output_size").alias("base_size"), F.min("total_time_ms").alias("base_time"))
    size = F.col("output_size").cast("double")
    return runs.join(base, by, "left").select(
        *runs.columns, F.try_divide(size, F.col("base_size")).alias("found_share"), F.try_divide(F.col("base_time").cast("double"), F.col("total_time_ms")).alias("times_faster"), (F.col("base_size") - F.col("output_size")).alias("lost")
    )


def best_runs(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows with the least value of each group, ties included."""
    return runs.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(value))).where("place = 1").drop("place")


def selectivity(runs: DataFrame) -> DataFrame:
    """runs (with output_size and n) with selectivity and average_neighbours."""
    n, out = F.col("n"), F.col("output_size")
    return runs.withColumn("selectivity", F.try_divide(out, n * (n - 1) / 2)).withColumn("average_neighbours", F.try_divide(out + n, n.cast("double")))


def spread_of_best(runs: DataFrame, by: list[str], algorithm: str = "algorithm", value: str = "total_time_ms") -> DataFrame:
    best = runs.groupBy(*by, algorithm).agg(F.min(value).alias("best"))
    return best.groupBy(*by).agg(F.min("best").alias("fastest"), F.max("best").alias("slowest"))


FRAME_RULES = (("deduplicate", "already_seen"), ("verify", "predicate"), ("sketch", "sketch"), ("hash", "hash"), ("communication", "exchange"))


def profile_categories(profile: DataFrame, rules: tuple[tuple[str, str], ...] = FRAME_RULES) -> DataFrame:
    """(id, category, frames): frames by the first rule whose substring the name holds."""
    category = F.lit("other")
    for name, part in reversed(rules):
        category = F.when(F.col("name").contains(part), name).otherwise(category)
    return profile.groupBy("id", category.alias("category")).agg(F.sum("frame_count").alias("frames"))


def pairs_per_frame(profile: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: (id, category, pairs) handled."""
    return profile_categories(profile).join(pairs, ["id", "category"]).select("id", "category", F.try_divide(F.col("pairs").cast("double"), F.col("frames")).alias("pairs_per_frame"))


def workers(runs: DataFrame) -> DataFrame:
    """runs with the number of workers: hosts (host:port pairs) times threads."""
    return runs.withColumn("workers", F.greatest(F.regexp_count("hosts", F.lit(":")), F.lit(1)) * F.col("threads"))


def scalability(runs: DataFrame) -> DataFrame:
    """(algorithm, workers, mean_time, best_time, gain): gain over the next smaller number of workers."""
    times = runs.groupBy("algorithm", "workers").agg(F.avg("total_time_ms").alias("mean_time"), F.min("total_time_ms").alias("best_time"))
    before = F.lag("best_time").over(Window.partitionBy("algorithm").orderBy("workers"))
    return times.withColumn("gain", F.try_divide(before.cast("double"), F.col("best_time").cast("double")))


def load_range(counters: DataFrame, network: DataFrame) -> DataFrame:
    load = worker_load(counters).groupBy("id").agg(F.min("load").alias("min_load"), F.max("load").alias("max_load"))
    net = network.groupBy("id").agg((F.sum("transmitted") / 1048576.0).alias("mb_sent"), (F.sum("received") / 1048576.0).alias("mb_received"))
    return load.join(net, "id", "left")


def message_bytes(item_bytes: int, k: int, hashers: int, sketch_bits: int, outer_hashers: int = 0) -> int:
    """Bytes of a row in flight: id and value, two half-hashes of 2 bytes a hasher at each level, and the sketch."""
    return 4 + item_bytes + 4 * hashers + 4 * outer_hashers + sketch_bits // 8 + 4 * (k > 0)


def memory_per_repetition(data_bytes: DataFrame, runs: DataFrame) -> DataFrame:
    """runs: (id, repetitions, threads)."""
    total = data_bytes.groupBy("id").agg(F.sum("datastructures_bytes").alias("bytes"))
    return total.join(runs, "id").select("id", F.try_divide(F.col("bytes").cast("double"), F.col("repetitions") * F.col("threads")).alias("bytes_per_repetition"))


def summary(bench: DataFrame, by: list[str], value: str) -> DataFrame:
    return bench.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("max"))


def sketch_grid(runs: DataFrame, by: list[str], bits: tuple[int, ...] = (64, 128, 256)) -> DataFrame:
    """Every sketch size for every configuration, with its best time or null, and the best of the configuration."""
    grid = runs.select(*by).distinct().withColumn("sketch_bits", F.explode(F.array(*map(F.lit, bits))))
    best = runs.groupBy(*by, "sketch_bits").agg(F.min("total_time_ms").alias("best"))
    return best.join(grid, [*by, "sketch_bits"], "right").withColumn("overall", F.min("best").over(Window.partitionBy(*by)))


def communication_phases(system: DataFrame, share: float = 0.1) -> DataFrame:
    """(id, begin, end): first and last sample whose traffic exceeds a share of the run's peak."""
    traffic = F.col("net_tx") + F.col("net_rx")
    peak = F.max(traffic).over(Window.partitionBy("id"))
    return system.withColumn("busy", traffic > peak * share).where("busy").groupBy("id").agg(F.min("time").alias("begin"), F.max("time").alias("end"))


def usage_of_fastest(runs: DataFrame, system: DataFrame, by: list[str]) -> DataFrame:
    fastest = best_runs(runs, by, "total_time_ms").select("id", *by)
    return system.join(fastest, "id")


def least_fraction(fractions: DataFrame, by: list[str]) -> DataFrame:
    return best_runs(fractions, by, "fraction")


def step_totals(counters: DataFrame) -> DataFrame:
    """(id, worker, first, total) candidates: of the first step, and of all."""
    c = counters.where("kind = 'CandidatePairs'")
    return c.groupBy("id", "worker").agg(F.sum(F.when(F.col("step") == 0, F.col("count")).otherwise(0)).alias("first"), F.sum("count").alias("total"))
