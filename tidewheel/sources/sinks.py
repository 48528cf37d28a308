"""Where aggregated points go: nowhere, the log, one folder per storage policy, or several of these at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.frames import label_key

Sink = Callable[[DataFrame, int], None]


def blackhole(batch: DataFrame, number: int) -> None:
    """Computes the batch and drops it."""
    batch.write.format("noop").mode("overwrite").save()


def logging(rows: int = 20) -> Sink:
    """Prints the head of each batch."""
    return lambda batch, number: batch.show(rows, truncate=False)


def folder(path: str, by: list[str] = ("policy",)) -> Sink:
    """Writes each batch once, under its number, partitioned so that reads prune by policy. A repeated batch replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").partitionBy(*(c for c in by if c in batch.columns)).parquet(f"{path}/batch={number}")


def sharded(path: str, shards: int) -> Sink:
    """Writes with a column ``shard`` by the hash of the series, so that one series is always in one shard."""
    def write(batch: DataFrame, number: int) -> None:
        shard = F.pmod(F.xxhash64("id", label_key(F.col("labels"))), F.lit(shards)).cast("int")
        batch.withColumn("shard", shard).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/batch={number}")

    return write


def multi(*sinks: Sink) -> Sink:
    """Every sink gets every batch; the batch is computed once."""
    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for s in sinks:
                s(kept, number)
        finally:
            kept.unpersist()

    return write


def passthrough(points: DataFrame, sink: Sink, number: int = 0) -> None:
    """Points aggregated elsewhere go straight to a sink."""
    sink(points, number)


def downsample_and_write(raw: DataFrame, raw_sink: Sink, aggregate: Callable[[DataFrame], DataFrame], aggregated_sink: Sink, number: int = 0) -> None:
    """A batch is stored as it came and, aggregated, once more."""
    raw_sink(raw, number)
    aggregated_sink(aggregate(raw), number)
