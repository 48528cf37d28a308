"""Aggregation types, storage policies and output names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.operators.frames import SECOND

# Quantile types by name.
QUANTILES = {"Median": 0.5, "P10": 0.1, "P20": 0.2, "P25": 0.25, "P30": 0.3, "P40": 0.4, "P50": 0.5, "P60": 0.6, "P70": 0.7, "P75": 0.75, "P80": 0.8, "P90": 0.9, "P95": 0.95, "P99": 0.99, "P999": 0.999, "P9999": 0.9999}
SIMPLE = ("Last", "Min", "Max", "Mean", "Count", "Sum", "SumSq", "Stdev")
# Default types per kind of metric.
DEFAULTS = {"counter": ["Sum"], "gauge": ["Last"], "timer": ["Sum", "SumSq", "Mean", "Min", "Max", "Count", "Stdev", "Median", "P50", "P95", "P99"]}
PREFIXES = {"counter": "stats.counts.", "timer": "stats.timers.", "gauge": "stats.gauges."}
SUFFIXES = {"Last": "last", "Min": "min", "Max": "max", "Mean": "mean", "Count": "count", "Sum": "sum", "SumSq": "sum_sq", "Stdev": "stdev", "Median": "median"}
UNITS = {"ns": 1e-3, "us": 1, "ms": 1000, "s": SECOND, "m": 60 * SECOND, "h": 3600 * SECOND, "d": 86400 * SECOND, "w": 7 * 86400 * SECOND, "y": 365 * 86400 * SECOND}


def duration(text: str) -> int:
    """``1m30s``, ``48h`` ... in microseconds."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|ms|[smhdwy])", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return round(sum(float(n) * UNITS[u] for n, u in parts))


@dataclass(frozen=True)
class StoragePolicy:
    """``resolution[@precision]:retention``, e.g. 1m:48h or 10s@1s:2d."""

    resolution: int
    retention: int
    precision: int | None = None

    @staticmethod
    def parse(text: str) -> StoragePolicy:
        m = re.fullmatch(r"([^:@]+)(?:@([^:|]+))?:([^|]+)", text)
        if not m:
            raise ValueError(f"not a storage policy: {text!r}")
        return StoragePolicy(duration(m[1]), duration(m[3]), duration(m[2]) if m[2] else None)

    def __str__(self) -> str:
        def t(us: int) -> str:
            for u in ("d", "h", "m", "s"):
                if us % UNITS[u] == 0:
                    return f"{us // UNITS[u]}{u}"
            return f"{us // 1000}ms"

        return f"{t(self.resolution)}:{t(self.retention)}"


def output_suffix(kind: str, agg: str) -> str:
    """Suffix of an output; the kind's only default type has none."""
    if DEFAULTS[kind] == [agg]:
        return ""
    return "." + SUFFIXES.get(agg, agg.lower())


def output_name(kind: str, name: str, agg: str) -> str:
    return PREFIXES[kind] + name + output_suffix(kind, agg)


def aggregate(agg: str, value: Column, order: Column, exact: bool = True) -> Column:
    """An aggregate by type. ``value`` is null where NaN; ``Count`` counts such values too. Stdev is a sample's, 0 below two values."""
    if agg in QUANTILES:
        q = F.lit(QUANTILES[agg])
        return F.percentile(value, q) if exact else F.percentile_approx(value, q, F.lit(1000)).cast("double")
    return {
        "Last": lambda: F.max_by(value, F.when(value.isNotNull(), order)),
        "Min": lambda: F.min(value),
        "Max": lambda: F.max(value),
        "Mean": lambda: F.coalesce(F.avg(value), F.lit(0.0)),
        "Count": lambda: F.count(F.lit(1)).cast("double"),
        "Sum": lambda: F.coalesce(F.sum(value), F.lit(0.0)),
        "SumSq": lambda: F.coalesce(F.sum(value * value), F.lit(0.0)),
        "Stdev": lambda: F.coalesce(F.when(F.count(value) > 1, F.stddev_samp(value)), F.lit(0.0)),
    }[agg]().cast("double")


def parse_types(text: str) -> list[str]:
    """Comma-separated type names."""
    known = {k.lower(): k for k in (*SIMPLE, *QUANTILES)}
    out = []
    for word in text.split(","):
        if word.strip().lower() not in known:
            raise ValueError(f"unknown aggregation type {word!r}")
        out.append(known[word.strip().lower()])
    return out
