"""Namespaces: the same series kept at several resolutions and retentions, and which of them answers a query."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.operators.frames import SeriesSource


@dataclass(frozen=True)
class Namespace:
    name: str
    resolution: int  # microseconds; 0 for unaggregated samples
    retention: int
    #: whether every series is kept here, or only those that rules send
    complete: bool = True
    source: SeriesSource | None = field(default=None, compare=False)


def choose(namespaces: list[Namespace], start: int, now: int) -> list[Namespace]:
    """The namespaces to read for data from ``start`` on.

    Unaggregated data if they reach back far enough, alone. Else of the complete aggregated ones that do the finest, with the partial ones that are
    finer. If none reaches back, the one with the longest retention.
    """
    raw = [n for n in namespaces if n.resolution == 0]
    if raw and now - raw[0].retention <= start:
        return raw[:1]
    able = [n for n in namespaces if n.resolution and now - n.retention <= start]
    whole = min((n for n in able if n.complete), key=lambda n: n.resolution, default=None)
    partial = sorted((n for n in able if not n.complete and (whole is None or n.resolution < whole.resolution)), key=lambda n: n.resolution)
    if whole or partial:
        return [*partial, *([whole] if whole else [])]
    return [max(namespaces, key=lambda n: (n.retention, -n.resolution))] if namespaces else []


def stitched(namespaces: list[Namespace], start: int, end: int, now: int) -> list[tuple[Namespace, int, int]]:
    """Time ranges by namespace: the unaggregated one as far back as it reaches, older times from the namespaces chosen for them."""
    raw = next((n for n in namespaces if n.resolution == 0), None)
    if raw is None or start >= now - raw.retention:
        return [(n, start, end) for n in choose(namespaces, start, now)]
    edge = min(max(start, now - raw.retention), end)
    older = [(n, start, edge - 1) for n in choose([n for n in namespaces if n is not raw], start, now)]
    return [*older, (raw, edge, end)] if edge <= end else older


def dedupe(parts: list[tuple[DataFrame, int, int]], complete: bool = True) -> DataFrame:
    """Union of (samples with sid, resolution, retention): each whole series from one part: the finest, or, for partial coverage, the longest kept, then the finest."""
    frames = [df.withColumn("__res", F.lit(res)).withColumn("__ret", F.lit(ret)) for df, res, ret in parts]
    rows = reduce(DataFrame.unionByName, frames)
    order = [F.col("__res")] if complete else [F.col("__ret").desc(), F.col("__res")]
    owner = rows.select("sid", "__res", "__ret").distinct().withColumn("__rn", F.row_number().over(Window.partitionBy("sid").orderBy(*order))).where("__rn = 1").drop("__rn")
    return rows.join(owner, ["sid", "__res", "__ret"], "left_semi").drop("__res", "__ret")


def merge_duplicates(samples: DataFrame, strategy: str = "last_pushed", pushed: str | None = None) -> DataFrame:
    """One value per series and time: last_pushed (by the column ``pushed``), highest, lowest or highest_frequency (ties: the higher value)."""
    keys = samples.groupBy("sid", "ts")
    if strategy == "last_pushed":
        return keys.agg(F.max_by("value", pushed).alias("value"))
    if strategy in ("highest", "lowest"):
        return keys.agg((F.max if strategy == "highest" else F.min)("value").alias("value"))
    if strategy == "highest_frequency":
        counts = samples.groupBy("sid", "ts", "value").agg(F.count(F.lit(1)).alias("__n"))
        return counts.groupBy("sid", "ts").agg(F.max(F.struct("__n", "value"))["value"].alias("value"))
    raise ValueError(f"unknown strategy {strategy}")


def retained(samples: DataFrame, retention: int, now: int, past: int | None = None, future: int | None = None, arrived: str | None = None) -> DataFrame:
    """Samples within retention; with ``arrived`` also those not written too late or too early."""
    rows = samples.where(F.col("ts") >= now - retention)
    if arrived:
        rows = rows.where((F.col(arrived) - F.col("ts") <= past) & (F.col("ts") - F.col(arrived) <= future))
    return rows


def write_namespace(samples: DataFrame, root: str, ns: Namespace) -> None:
    """Appends samples to the namespace's folder, by day, so that reads prune by namespace and date."""
    day = F.date_from_unix_date(F.floor(F.col("ts") / 86_400_000_000).cast("int"))
    samples.withColumn("ns", F.lit(ns.name)).withColumn("date", day).write.mode("append").partitionBy("ns", "date").parquet(root)


def read_namespace(spark, root: str, ns: Namespace, start: int, end: int) -> DataFrame:
    rows = spark.read.parquet(root).where(F.col("ns") == ns.name)
    low, high = (F.date_from_unix_date(F.lit(t // 86_400_000_000)) for t in (start, end))
    return rows.where((F.col("date") >= low) & (F.col("date") <= high) & (F.col("ts") >= start) & (F.col("ts") <= end)).drop("ns", "date")
