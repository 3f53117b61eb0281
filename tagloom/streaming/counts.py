"""Counts kept up to date by a stream: one partial table per micro-batch, summed on reading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def keep_counts(stream: DataFrame, path: str, count: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes ``count`` of each micro-batch to its own folder below ``path``.

    A batch that is run again overwrites its folder, so each row counts exactly once.
    ``count`` must be additive, such as the pair counts of whole baskets.
    """

    def write(batch: DataFrame, number: int) -> None:
        count(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def read_counts(spark: SparkSession, path: str, keys: list[str], value: str = "count") -> DataFrame:
    """The sum over all batches so far."""
    return spark.read.option("basePath", path).parquet(path).groupBy(*keys).agg(F.sum(value).alias(value))
