"""Results for clients: JSON, pickled Graphite lists, and down-sampling for display."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.frames import SECOND
from tidewheel.session import ship


def _number(value):
    return F.when(F.isnan(value), F.lit("NaN")).when(value == float("inf"), F.lit("+Inf")).when(value == float("-inf"), F.lit("-Inf")).otherwise(F.regexp_replace(value.cast("string"), r"\.0$", ""))


def matrix_json(vector: DataFrame) -> DataFrame:
    """One JSON text per series: {"metric": {...}, "values": [[seconds, "value"], ...]}."""
    point = F.struct("step", F.concat(F.lit("["), F.regexp_replace((F.col("step") / SECOND).cast("decimal(20,3)").cast("string"), r"\.?0+$", ""), F.lit(',"'), _number(F.col("value")), F.lit('"]')).alias("t"))
    rows = vector.groupBy("labels").agg(F.transform(F.sort_array(F.collect_list(point)), lambda p: p["t"]).alias("v"))
    return rows.select(F.concat(F.lit('{"metric":'), F.to_json("labels"), F.lit(',"values":['), F.concat_ws(",", "v"), F.lit("]}")).alias("json"))


def vector_json(vector: DataFrame) -> DataFrame:
    """One JSON text per series of an instant vector."""
    at = F.regexp_replace((F.col("step") / SECOND).cast("decimal(20,3)").cast("string"), r"\.?0+$", "")
    return vector.select(F.concat(F.lit('{"metric":'), F.to_json("labels"), F.lit(',"value":['), at, F.lit(',"'), _number(F.col("value")), F.lit('"]}')).alias("json"))


def response(kind: str, parts: Iterator[str], warnings: list[str] = ()) -> Iterator[str]:
    """A whole response in pieces, for a stream of series."""
    yield '{"status":"success",'
    if warnings:
        import json

        yield f'"warnings":{json.dumps(list(warnings))},'
    yield f'"data":{{"resultType":"{kind}","result":['
    for i, p in enumerate(parts):
        yield ("," if i else "") + p
    yield "]}}"


def limited(vector: DataFrame, max_series: int, require_exhaustive: bool = False) -> tuple[DataFrame, bool]:
    """At most ``max_series`` series, and whether that is all of them; with ``require_exhaustive`` more are an error."""
    keyed = vector.withColumn("__k", F.xxhash64(F.to_json(F.array_sort(F.map_entries("labels")))))
    some = keyed.select("__k").distinct().orderBy("__k").limit(max_series + 1)
    n = some.count()
    if n <= max_series:
        return vector, True
    if require_exhaustive:
        raise ValueError(f"the query matches more than {max_series} series")
    return keyed.join(F.broadcast(some.orderBy("__k").limit(max_series)), "__k", "left_semi").drop("__k"), False


def graphite_pickle(rows: DataFrame, start: int, end: int, step: int) -> bytes:
    """A render result as pickle; ``rows`` are name, step, value of the series shown, which a client displays and so fits the driver."""
    count = (end - start) // step + 1
    out = []
    for name, part in rows.toPandas().groupby("name", sort=False):
        values: list[float | None] = [None] * count
        for t, v in zip(part["step"], part["value"]):
            values[int((t - start) // step)] = float(v)
        out.append({"name": name, "start": start // SECOND, "end": (end + step) // SECOND, "step": step // SECOND, "values": values})
    return pickle.dumps(out, protocol=2)


def lttb_points(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the n points kept by largest triangles, one per bucket, with both ends."""
    m = len(x)
    if n >= m or n < 3:
        return np.arange(m) if n >= m else np.array([0, m - 1][: max(n, 0)])
    edges = (np.arange(n - 1) * (m - 2) / (n - 2)).astype(int) + 1
    kept, at = [0], 0
    for i in range(n - 2):
        low, high = edges[i], edges[i + 1]
        after = slice(high, edges[i + 2] if i + 2 < len(edges) else m)
        cx, cy = x[after].mean(), y[after].mean()
        area = np.abs((x[at] - cx) * (y[low:high] - y[at]) - (x[at] - x[low:high]) * (cy - y[at]))
        at = low + int(np.argmax(area))
        kept.append(at)
    return np.array([*kept, m - 1])


def lttb(rows: DataFrame, keys: list[str], time: str, value: str, points: int) -> DataFrame:
    """Largest-triangle-three-buckets per series: at most ``points`` rows of each, chosen so that the shape stays.

    The choice of a point depends on the one before, so a series is one task; it follows aggregation to a grid, which bounds it.
    """
    ship(rows.sparkSession)
    schema = rows.select(*keys, time, value).schema

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(time)
        return pdf.iloc[lttb_points(pdf[time].to_numpy(float), pdf[value].to_numpy(float), points)]

    return rows.select(*keys, time, value).groupBy(*keys).applyInPandas(down, schema)
