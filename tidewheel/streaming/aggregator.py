"""The aggregator as streaming queries: windows closed by the watermark, suppressed repeats, corrections in update mode, chained transforms.

Stream rows: id, labels, kind, ts (microseconds), value, arrived (microseconds), and for forwarded values source and version.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewheel.aggregator.types import aggregate
from tidewheel.operators.frames import SECOND, label_key
from tidewheel.session import ship


def _timed(stream: DataFrame, past: int) -> DataFrame:
    return stream.withColumn("event_time", F.timestamp_micros("ts")).withWatermark("event_time", f"{past // SECOND} seconds")


def windowed_stream(stream: DataFrame, resolution: int, types: list[str], *, past: int = 600 * SECOND, future: int = 60 * SECOND, forwarded: bool = False) -> DataFrame:
    """Tumbling windows per metric, given out once the watermark passes their end (append mode), later corrections in update mode.

    Values too far ahead of their arrival are dropped by filter, those too late by the watermark. ``ts`` is the window's end, or its start for forwarded
    values. State per open window is the partial aggregates; a heavy metric is reduced on the map side.
    """
    rows = _timed(stream.where(F.col("ts") - F.col("arrived") <= future), past).withColumn("label_key", label_key(F.col("labels")))
    value = F.when(~F.isnan("value"), F.col("value"))
    got = rows.groupBy(F.window("event_time", f"{resolution // SECOND} seconds").alias("w"), "id", "kind", "label_key").agg(F.first("labels").alias("labels"), *(aggregate(t, value, F.col("ts"), exact=False).alias(t) for t in types))
    at = F.unix_micros(F.col("w.start") if forwarded else F.col("w.end"))
    long = F.inline(F.array(*(F.struct(F.lit(t).alias("agg"), F.col(t).alias("value")) for t in types)))
    return got.select("id", "labels", "kind", at.alias("ts"), long)


def without_repeats(stream: DataFrame, *, past: int = 600 * SECOND) -> DataFrame:
    """The first delivery of each (metric, source, version, time) within the lateness allowed; state is dropped with the watermark."""
    return _timed(stream, past).dropDuplicatesWithinWatermark(["id", "source", "version", "ts"]).drop("event_time")


def increases(points: DataFrame, per_second: bool = False, *, idle: int | None = None) -> DataFrame:
    """Increase or PerSecond between a metric's consecutive windows, also for windows that come late or are corrected.

    The state of a metric is its recent windows (within an hour of the latest); a corrected window gives out its own change and that of the next one. With
    ``idle`` (microseconds) a metric without any window for that long of processing time is forgotten, so that dead metrics leave no state behind; for
    queries that run continuously, as a query that stops once it has caught up would wait for the timeouts.
    """
    ship(points.sparkSession)

    def step(key: tuple, batches, state: GroupState):
        if idle is not None and state.hasTimedOut:
            state.remove()
            return
        known: dict[int, float] = dict(zip(*state.get)) if state.exists else {}
        touched = set()
        for pdf in batches:
            for ts, v in zip(pdf["ts"], pdf["value"]):
                if known.get(int(ts)) != float(v):
                    known[int(ts)] = float(v)
                    touched.add(int(ts))
        order = sorted(known)
        out = []
        for i, ts in enumerate(order):
            before = order[i - 1] if i else None
            if ts not in touched and before not in touched:
                continue
            rise = known[ts] - (known[before] if before is not None else 0.0)
            if rise < 0 or (per_second and before is None):
                continue
            out.append((key[0], key[1], ts, rise * SECOND / (ts - before) if per_second else rise))
        recent = [t for t in order if t >= order[-1] - 3600 * SECOND] if order else []
        state.update((recent, [known[t] for t in recent]))
        if idle is not None:
            state.setTimeoutDuration(idle // 1000)
        yield pd.DataFrame(out, columns=["id", "label_key", "ts", "value"])

    keyed = points.withColumn("label_key", label_key(F.col("labels"))).select("id", "label_key", "ts", "value")
    return keyed.groupBy("id", "label_key").applyInPandasWithState(
        step, "id string, label_key string, ts bigint, value double", "ts array<bigint>, value array<double>", "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    )


def write_flushed(stream: DataFrame, path: str, checkpoint_dir: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None):
    """Starts the query that writes closed windows to a namespace's folder, exactly once per batch; runs through what is available and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True)
    if each is None:
        def each(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return writer.foreachBatch(each).start()


def merge_corrections(flushed: DataFrame) -> DataFrame:
    """The latest version of each window from batches written in update mode."""
    keyed = flushed.withColumn("__l", label_key(F.col("labels")))
    return keyed.groupBy("id", "__l", "kind", "agg", "ts").agg(F.max_by(F.struct("labels", "value"), "batch").alias("x")).select("id", "x.labels", "kind", "agg", "ts", "x.value")
