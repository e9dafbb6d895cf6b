"""A stream of items looked up in a static dataset, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from affinis.operators.rsjoin import similarity_join


def lookup(stream: DataFrame, base: DataFrame, id_col: str, value_col: str, threshold: float, **options) -> DataFrame:
    """A streaming DataFrame of (id_l, id_r, similarity): a stream-static join, so it keeps no state and runs in append mode."""
    if not stream.isStreaming:
        raise ValueError("the left side must be a stream")
    return similarity_join(stream, base, id_col, value_col, threshold, **options)


def write(pairs: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append pairs to Parquet; checkpoint must lie in a folder that the cluster shares."""
    out = pairs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()
