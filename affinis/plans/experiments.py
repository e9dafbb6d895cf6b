"""Runs of joins as experiments: configuration, fingerprint, store, grids and a command line."""

from __future__ import annotations

import argparse
import hashlib
import itertools
import json
import threading
import time
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators.selfjoin import similarity_self_join
from affinis.plans.results import RUN

#: Raised whenever an algorithm's results or cost change.
VERSIONS = {"cartesian": 1, "local-lsh": 1, "one-level-lsh": 1, "two-level-lsh": 1}


@dataclass(frozen=True)
class Config:
    path: str
    threshold: float
    algorithm: str = "cartesian"
    k: int = 8
    k2: int = 6
    sketch_bits: int = 0
    sketch_epsilon: float = 0.01
    recall: float = 0.8
    seed: int = 14598
    dry_run: bool = False
    id_col: str = "id"
    value_col: str = "v"

    def fingerprint(self) -> str:
        fields = sorted((asdict(self) | {"version": VERSIONS[self.algorithm]}).items())
        return hashlib.sha256(json.dumps(fields).encode()).hexdigest()


def grid(**choices: Iterable) -> Iterator[Config]:
    """All combinations of the given values of the fields."""
    for values in itertools.product(*choices.values()):
        yield Config(**dict(zip(choices, values, strict=True)))


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The store's runs; none if it doesn't exist yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(RUN).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUN)


def already_run(spark: SparkSession, config: Config, store: str) -> bool:
    return not stored(spark, store).where(F.col("params_sha") == config.fingerprint()).isEmpty()


def record(spark: SparkSession, config: Config, store: str, took_ms: int | None, output_size: int | None) -> None:
    """Append a run; a run that timed out has no time and no output. Recall and speedup are against the stored exact run."""
    base = stored(spark, store).where((F.col("algorithm") == "cartesian") & (F.col("sketch_bits") == 0) & (F.col("path") == config.path) & (F.col("threshold") == config.threshold) & F.col("output_size").isNotNull())
    exact = base.orderBy(F.desc("date")).first()
    share = lambda a, b: None if not exact or a is None or not b else a / b
    row = {
        "id": time.time_ns(), "date": datetime.now(UTC).isoformat(), "code_version": "1", "params_sha": config.fingerprint(), "seed": config.seed, "threshold": float(config.threshold), "algorithm": config.algorithm,
        "algorithm_version": VERSIONS[config.algorithm], "k": config.k, "k2": config.k2, "sketch_bits": config.sketch_bits, "threads": spark.sparkContext.defaultParallelism, "hosts": spark.sparkContext.master,
        "sketch_epsilon": config.sketch_epsilon, "required_recall": config.recall, "no_dedup": False, "no_verify": False, "repetition_batch": 0, "balance": "adaptive", "path": config.path, "total_time_ms": took_ms,
        "output_size": output_size, "recall": share(output_size, exact["output_size"] if exact else None), "speedup": share(exact["total_time_ms"] if exact else None, took_ms), "profile_frequency": 0, "dry_run": config.dry_run,
    }
    spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(store)


def run(spark: SparkSession, config: Config, store: str, rerun: bool = False, timeout: float | None = None) -> int | None:
    """The number of pairs; None if the run was there already or took longer than timeout seconds (which is recorded)."""
    if not rerun and already_run(spark, config, store):
        return None
    df = spark.read.parquet(config.path)
    tag = f"affinis-{time.time_ns()}"
    done, expired = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(timeout):
            expired.set()
            while not done.wait(0.1):  # jobs that start after the first call are cancelled too
                spark.sparkContext.cancelJobsWithTag(tag)

    spark.sparkContext.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True) if timeout else None
    began = time.perf_counter()
    pairs = None
    try:
        if watcher:
            watcher.start()
        pairs = similarity_self_join(
            df, config.id_col, config.value_col, config.threshold, config.algorithm, config.k, config.k2, config.recall, config.seed, config.sketch_bits, config.sketch_epsilon, config.dry_run
        ).count()
    except Exception as error:
        if not (expired.is_set() and cancelled(error)):
            raise
    finally:
        done.set()
        if watcher:
            watcher.join()
        spark.sparkContext.removeJobTag(tag)
    took = time.perf_counter() - began
    if timeout and took > timeout:  # a run that ended between two looks of the watcher was too slow as well
        pairs = None
    record(spark, config, store, None if pairs is None else int(1000 * took), pairs)
    return pairs


def cancelled(error: BaseException | None) -> bool:
    """Whether an error comes from the cancellation of a job."""
    while error is not None:
        if "cancel" in str(error).lower():
            return True
        error = error.__cause__
    return False


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="affinis", description="Count the similar pairs of a dataset of vectors or token sets.")
    parser.add_argument("path")
    parser.add_argument("--threshold", type=float, required=True)
    parser.add_argument("--algorithm", choices=sorted(VERSIONS), default="cartesian")
    for name in ("k", "k2", "sketch-bits", "seed"):
        parser.add_argument(f"--{name}", type=int, default=getattr(Config, name.replace("-", "_")))
    for name in ("sketch-epsilon", "recall"):
        parser.add_argument(f"--{name}", type=float, default=getattr(Config, name.replace("-", "_")))
    for name in ("id-col", "value-col"):
        parser.add_argument(f"--{name}", default=getattr(Config, name.replace("-", "_")))
    parser.add_argument("--dry-run", action="store_true", help="count candidates only")
    parser.add_argument("--rerun", action="store_true", help="run even if the store has this configuration")
    parser.add_argument("--timeout", type=float, help="seconds")
    parser.add_argument("--store", default="runs.parquet")
    got = vars(parser.parse_args(args))
    store, rerun, timeout = got.pop("store"), got.pop("rerun"), got.pop("timeout")
    spark = SparkSession.builder.appName("affinis").getOrCreate()
    print(run(spark, Config(**got), store, rerun, timeout))


if __name__ == "__main__":
    main()
