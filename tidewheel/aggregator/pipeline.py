"""Batch aggregation: windows, transforms and rollups folded over a frame in the order of a pipeline.

Input rows: ``id`` (metric name), ``labels``, ``kind`` (counter, gauge, timer), ``ts`` (microseconds), ``value``; a timer's batch is one row per value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.aggregator.types import DEFAULTS, aggregate
from tidewheel.operators.frames import drop_labels, keep_labels, label_key
from tidewheel.operators.vectors import literal_labels


@dataclass(frozen=True)
class Aggregate:
    types: tuple[str, ...] = ()


@dataclass(frozen=True)
class Transform:
    """Absolute, Add, PerSecond, Increase or Reset."""

    name: str


@dataclass(frozen=True)
class Rollup:
    """A new metric over the labels kept (group) or not excluded; ``{{ .MetricName }}`` in the name is the metric's own."""

    name: str
    labels: tuple[str, ...]
    exclude: bool = False
    types: tuple[str, ...] = ("Sum",)


@dataclass
class Pipeline:
    ops: list = field(default_factory=list)


def values_of(rows: DataFrame) -> DataFrame:
    """Client records (type, counter_val, batch_timer, gauge_val) to one row per value; a record without a value gives none."""
    batch = F.when(F.col("type") == "timer", F.col("batch_timer")).when(F.col("type") == "gauge", F.array("gauge_val")).otherwise(F.array(F.col("counter_val").cast("double")))
    out = rows.withColumn("value", F.explode(batch)).withColumnRenamed("type", "kind").drop("counter_val", "batch_timer", "gauge_val")
    return out.where("value is not null")


def window_start(ts: Column, resolution: int) -> Column:
    return (F.floor(ts / resolution) * resolution).cast("bigint")


def timely(rows: DataFrame, arrived: str, past: int, future: int) -> DataFrame:
    """Drops values more than ``future`` ahead of their arrival or more than ``past`` behind it."""
    late = F.col(arrived) - F.col("ts")
    return rows.where((late <= past) & (late >= -future))


def first_deliveries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per source and version: repeated deliveries are left out."""
    return rows.dropDuplicates(keys)


def windowed(rows: DataFrame, resolution: int, types: list[str] | None = None, exact: bool = True, discard_nan: bool = True, forwarded: bool = False) -> DataFrame:
    """One row per metric, window and type: id, labels, kind, agg, ts, value. ``ts`` is the window's end, or its start for forwarded values.

    A heavy metric is reduced on the map side; exact quantiles hold a window's distinct values, approximate ones a sketch.
    """
    value = F.when(~F.isnan("value"), F.col("value"))
    base = rows.withColumn("__w", window_start(F.col("ts"), resolution)).withColumn("__l", label_key(F.col("labels")))
    wanted = sorted({t for ts in (types,) if ts for t in ts} or {t for ts in DEFAULTS.values() for t in ts})
    exprs = [aggregate(t, value, F.col("ts"), exact).alias(t) for t in wanted]
    got = base.groupBy("id", "__l", "kind", "__w").agg(F.first("labels").alias("labels"), *exprs)
    per_kind = {k: types or ts for k, ts in DEFAULTS.items()}
    allowed = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, ts in per_kind.items() for t in ts))
    long = got.select("id", "labels", "kind", "__w", F.explode(F.array(*(F.struct(F.lit(t).alias("agg"), F.col(t).alias("value")) for t in wanted))).alias("x"))
    long = long.where(F.exists(allowed, lambda a: (a["k"] == F.col("kind")) & (a["t"] == F.col("x.agg"))))
    end = F.col("__w") if forwarded else F.col("__w") + resolution
    out = long.select("id", "labels", "kind", F.col("x.agg").alias("agg"), end.alias("ts"), F.col("x.value").alias("value"))
    return out.where("value is not null and not isnan(value)") if discard_nan else out


def transformed(points: DataFrame, name: str, resolution: int) -> DataFrame:
    """A transform over each metric's own windows in order."""
    w = Window.partitionBy("id", "__l", "kind", "agg").orderBy("ts")
    rows = points.withColumn("__l", label_key(F.col("labels")))
    v, prev, at = F.col("value"), F.lag("value").over(w), F.lag("ts").over(w)
    if name == "Absolute":
        rows = rows.withColumn("value", F.abs(v))
    elif name == "Add":
        rows = rows.withColumn("value", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    elif name == "PerSecond":  # nothing for the first window, nor for a falling value
        rows = rows.withColumn("__p", prev).withColumn("__t", at).withColumn("value", F.when(v >= F.col("__p"), (v - F.col("__p")) * 1e6 / (F.col("ts") - F.col("__t"))))
    elif name == "Increase":  # from 0 at first; nothing for a falling value
        rows = rows.withColumn("__p", F.coalesce(prev, F.lit(0.0))).withColumn("value", F.when(v >= F.col("__p"), v - F.col("__p")))
    elif name == "Reset":  # the value, and 0 half a window later
        both = F.array(F.struct(F.col("ts").alias("ts"), v.alias("value")), F.struct((F.col("ts") + resolution // 2).alias("ts"), F.lit(0.0).alias("value")))
        rows = rows.withColumn("__b", F.explode(both)).withColumn("ts", F.col("__b.ts")).withColumn("value", F.col("__b.value"))
    else:
        raise ValueError(f"unknown transform {name}")
    return rows.where("value is not null").select("id", "labels", "kind", "agg", "ts", "value")


def rolled_up(points: DataFrame, r: Rollup, resolution: int) -> DataFrame:
    """Values of the metrics that have all labels to group by, aggregated again under the new name."""
    labels = F.col("labels")
    rows = points
    if not r.exclude:
        for k in r.labels:
            rows = rows.where(F.map_contains_key("labels", k))
    kept = drop_labels(labels, list(r.labels)) if r.exclude else keep_labels(labels, list(r.labels))
    name = F.replace(F.replace(F.lit(r.name), F.lit("{{ .MetricName }}"), F.col("id")), F.lit("{{.MetricName}}"), F.col("id"))
    rows = rows.withColumn("id", name).withColumn("labels", F.map_concat(drop_labels(kept, ["__rollup__"]), literal_labels({"__rollup__": "true"})))
    rows = rows.withColumn("__l", label_key(F.col("labels")))
    value = F.when(~F.isnan("value"), F.col("value"))
    got = rows.groupBy("id", "__l", "kind", "ts").agg(F.first("labels").alias("labels"), *(aggregate(t, value, F.col("ts")).alias(t) for t in r.types))
    return got.select("id", "labels", "kind", "ts", F.inline(F.array(*(F.struct(F.lit(t).alias("agg"), F.col(t).alias("value")) for t in r.types)))).select("id", "labels", "kind", "agg", "ts", "value")


def run(rows: DataFrame, pipeline: Pipeline, resolution: int) -> DataFrame:
    """Folds a pipeline: aggregation first (the kinds' default types if none is given), then transforms and rollups in order."""
    ops = list(pipeline.ops)
    types = list(ops.pop(0).types) if ops and isinstance(ops[0], Aggregate) else None
    points = windowed(rows, resolution, types or None)
    for op in ops:
        points = transformed(points, op.name, resolution) if isinstance(op, Transform) else rolled_up(points, op, resolution)
    return points


def tiles(samples: DataFrame, width: int, agg: str = "Last") -> DataFrame:
    """Large-tile downsampling of stored samples (sid, ts, value) between namespaces: one value per series and tile, at the tile's end."""
    w = window_start(F.col("ts"), width)
    return samples.where("value is not null and not isnan(value)").groupBy("sid", (w + width).alias("ts")).agg(aggregate(agg, F.col("value"), F.col("ts")).alias("value")).select("sid", "ts", "value")
