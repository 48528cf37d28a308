"""Functions on lists of dotted-path series.

A series list is a frame ``ord, name, step, value`` on one grid. ``ord`` is a sortable text with the order of the list, which some functions depend on;
an absent value is an absent row. Every function returns a new list; nothing is collected.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.functions import num
from tidewheel.functions.paths import glob_to_regex, parse_interval
from tidewheel.operators.frames import SECOND, Grid


@dataclass
class SeriesList:
    frame: DataFrame
    grid: Grid

    def on(self, frame: DataFrame) -> SeriesList:
        return SeriesList(frame.select("ord", "name", "step", "value"), self.grid)

    def where(self, condition: Column) -> SeriesList:
        return self.on(self.frame.where(condition))

    def dense(self) -> DataFrame:
        """All steps of every series, with nulls. A series' points are as many as the grid's steps."""
        points = self.frame.groupBy("ord", "name").agg(F.map_from_entries(F.collect_list(F.struct("step", "value"))).alias("p"))
        g = self.grid
        steps = F.sequence(F.lit(g.start), F.lit(g.start + (g.count - 1) * g.step), F.lit(g.step))
        return points.select("ord", "name", "p", F.explode(steps).alias("step")).select("ord", "name", "step", F.try_element_at("p", F.col("step")).alias("value"))


def path_of(name: Column) -> Column:
    """The path within a name such as ``scale(a.b.c,2)``: the first run of path characters that is an argument or the whole name."""
    found = F.regexp_extract(name, r"(?:^|[(,\s])([^(),'\"\s]+)(?=$|[),\s])", 1)
    return F.when(found != "", found).otherwise(name)


def node(i: int) -> Column:
    """The i-th part of the path, counted from the end if negative."""
    return F.coalesce(F.try_element_at(F.split(path_of(F.col("name")), r"\."), F.lit(i + 1 if i >= 0 else i)), F.lit(""))


def _ordered_values() -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"])


def _percentile_of(values: Column, p: float, interpolate: bool) -> Column:
    """Percentile by rank p/100*(n+1) over an array; without interpolation the rank is rounded up."""
    s = F.array_sort(values)
    n = F.size(values)
    exact = F.lit(p / 100.0) * (n + 1)
    low = F.floor(exact).cast("int")
    rank = low if interpolate else low + F.ceil(exact - low).cast("int")
    rank = F.least(F.greatest(rank, F.lit(0)), n)
    base = F.try_element_at(s, F.greatest(rank, F.lit(1)))
    if interpolate:
        after = F.try_element_at(s, F.least(rank + 1, n))
        base = F.when(rank < n, base + (exact - low) * (after - base)).otherwise(base)
    return F.when(n > 0, base)


AGGREGATES: dict[str, Callable[[], Column]] = {
    "sum": lambda: F.sum("value"),
    "avg": lambda: F.avg("value"),
    "min": lambda: F.min("value"),
    "max": lambda: F.max("value"),
    "median": lambda: F.median("value"),
    "stddev": lambda: F.stddev_pop("value"),
    "range": lambda: F.max("value") - F.min("value"),
    "multiply": lambda: F.product("value"),
    "last": lambda: F.max_by("value", "ord"),
    "count": lambda: F.count("value").cast("double"),
    "diff": lambda: F.aggregate(F.slice(_ordered_values(), 2, 1 << 30), _ordered_values()[0], lambda a, x: a - x),
    "pow": lambda: F.aggregate(F.slice(_ordered_values(), 2, 1 << 30), _ordered_values()[0], lambda a, x: num.power(a, x)),
}
ALIASES = {"average": "avg", "total": "sum", "current": "last", "rangeOf": "range", "minimum": "min", "maximum": "max", "stdev": "stddev"}


def aggregate_name(name: str) -> str:
    """``sumSeries``, ``total``, ``sum`` ... to the aggregate's own name."""
    name = name.removesuffix("Series")
    name = ALIASES.get(name, name)
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregation {name!r}")
    return name


def combine(x: SeriesList, f: str, label: str, by: Column | None = None) -> SeriesList:
    """One series for the list, or one per value of ``by``, which then names it; steps where all are absent are absent."""
    f = aggregate_name(f)
    key = F.lit(label) if by is None else by
    rows = x.frame.withColumn("__key", key).where("value is not null")
    if f == "diff":
        # the first series of the list counts positive, also at steps where it is absent
        first = x.frame.withColumn("__key", key).groupBy("__key").agg(F.min("ord").alias("__first"))
        rows = rows.join(first, "__key")
        out = rows.groupBy("__key", "step").agg(F.sum(F.when(F.col("ord") == F.col("__first"), F.col("value")).otherwise(-F.col("value"))).alias("value"))
    elif f == "count":
        total = x.frame.withColumn("__key", key).groupBy("__key").agg(F.countDistinct("ord").cast("double").alias("n"))
        g = x.grid
        out = total.select("__key", F.explode(F.sequence(F.lit(g.start), F.lit(g.start + (g.count - 1) * g.step), F.lit(g.step))).alias("step"), F.col("n").alias("value"))
    else:
        out = rows.groupBy("__key", "step").agg(AGGREGATES[f]().alias("value"))
    return x.on(out.select(F.col("__key").alias("ord"), F.col("__key").alias("name"), "step", "value"))


def covered(combined: SeriesList, x: SeriesList, x_files: float) -> SeriesList:
    """The steps of ``combined`` at which at least a share ``x_files`` of the list's series have a value."""
    if x_files <= 0:
        return combined
    total = x.frame.agg(F.countDistinct("ord").alias("__total"))
    steps = x.frame.where("value is not null").groupBy("step").agg(F.countDistinct("ord").alias("__n"))
    kept = steps.crossJoin(F.broadcast(total)).where(F.col("__n") >= F.col("__total") * F.lit(float(x_files))).select("step")
    return combined.on(combined.frame.join(kept, "step", "left_semi"))


def percentile_of_series(x: SeriesList, n: float, interpolate: bool = False) -> SeriesList:
    out = x.frame.where("value is not null").groupBy("step").agg(_percentile_of(F.collect_list("value"), n, interpolate).alias("value"))
    label = F.lit(f"percentileOfSeries({n:g})")
    return x.on(out.select(label.alias("ord"), label.alias("name"), "step", "value"))


def group_by_nodes(x: SeriesList, f: str, *nodes: int) -> SeriesList:
    return combine(x, f, "", F.concat_ws(".", *(node(i) for i in nodes)))


def with_wildcards(x: SeriesList, f: str, *positions: int) -> SeriesList:
    """Groups by the path without the parts at ``positions``."""
    parts = F.split(path_of(F.col("name")), r"\.")
    kept = F.filter(parts, lambda _, i: ~i.isin([F.lit(p) for p in positions])) if positions else parts
    return combine(x, f, "", F.concat_ws(".", kept))


def divide(x: SeriesList, y: SeriesList, pairwise: bool = False) -> SeriesList:
    """Each series of x by the one series of y, or the i-th by the i-th; division by zero is absent."""
    def numbered(f: DataFrame) -> DataFrame:
        order = f.select("ord").distinct().groupBy().agg(F.sort_array(F.collect_list("ord")).alias("o")).select(F.posexplode("o").alias("i", "ord"))
        return f.join(order, "ord")

    a, b = x.frame, y.frame
    keys = ["step"]
    if pairwise:
        a, b, keys = numbered(a), numbered(b), ["i", "step"]
    b = b.select(*keys, F.col("value").alias("d"), F.col("name").alias("d_name"))
    both = a.join(b, keys).where("d != 0")
    return x.on(both.select("ord", F.concat(F.lit("divideSeries("), "name", F.lit(","), "d_name", F.lit(")")).alias("name"), "step", (F.col("value") / F.col("d")).alias("value")))


def weighted_average(x: SeriesList, weights: SeriesList, n: int) -> SeriesList:
    a = x.frame.select(node(n).alias("k"), "step", "value")
    w = weights.frame.select(node(n).alias("k"), "step", F.col("value").alias("w"))
    both = a.join(w.select("k").distinct(), "k", "left_semi").join(w, ["k", "step"], "left")
    used = w.join(a.select("k").distinct(), "k", "left_semi").groupBy("step").agg(F.sum("w").alias("w"))
    out = both.groupBy("step").agg(F.sum(F.col("value") * F.col("w")).alias("v")).join(used, "step").where("w != 0 and v is not null")
    label = F.lit("weightedAverage")
    return x.on(out.select(label.alias("ord"), label.alias("name"), "step", (F.col("v") / F.col("w")).alias("value")))


def as_percent(x: SeriesList, total: SeriesList | float | None = None) -> SeriesList:
    """Share of the total per step: of the list itself, of another list, or of a number."""
    if isinstance(total, (int, float)):
        return each(x, "asPercent", F.col("value") / F.lit(float(total)) * 100) if total else x.where(F.lit(False))
    whole = (total or x).frame.groupBy("step").agg(F.sum("value").alias("t"))
    both = x.frame.join(whole, "step").where("t != 0")
    return x.on(both.select("ord", F.concat(F.lit("asPercent("), "name", F.lit(")")).alias("name"), "step", (F.col("value") / F.col("t") * 100).alias("value")))


def renamed(x: SeriesList, name: Column) -> SeriesList:
    return x.on(x.frame.withColumn("name", name))


def each(x: SeriesList, f: str, value: Column, *args: object) -> SeriesList:
    """A value-wise function that names its result ``f(name,args)``."""
    tail = "".join(f",{a:g}" if isinstance(a, float) else f",{a}" for a in args)
    out = x.frame.withColumn("value", value.cast("double")).withColumn("name", F.concat(F.lit(f + "("), "name", F.lit(tail + ")")))
    return x.on(out.where("value is not null"))


def _window(x: SeriesList, f: str, value: Callable[[object], Column], *args: object) -> SeriesList:
    """A function of a series' own steps in order, over its dense form."""
    w = Window.partitionBy("ord", "name").orderBy("step")
    return each(x.on(x.dense().withColumn("value", value(w).cast("double"))), f, F.col("value"), *args)


def _prev(w, column: str = "value") -> Column:
    return F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def derivative(x: SeriesList) -> SeriesList:
    return _window(x, "derivative", lambda w: F.col("value") - F.lag("value").over(w))


def non_negative_derivative(x: SeriesList, max_value: float | None = None) -> SeriesList:
    def value(w) -> Column:
        d = F.col("value") - F.lag("value").over(w)
        wrapped = F.lit(None).cast("double") if max_value is None else F.when(F.col("value") <= max_value, max_value - F.lag("value").over(w) + F.col("value") + 1)
        return F.when(d >= 0, d).otherwise(wrapped)

    return _window(x, "nonNegativeDerivative", value)


def per_second(x: SeriesList) -> SeriesList:
    def value(w) -> Column:
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        at = F.last(F.when(F.col("value").isNotNull(), F.col("step")), ignorenulls=True).over(before)
        d = F.col("value") - _prev(w)
        return F.when(d >= 0, d / ((F.col("step") - at) / SECOND))

    return _window(x, "perSecond", value)


def integral(x: SeriesList) -> SeriesList:
    return _window(x, "integral", lambda w: F.when(F.col("value").isNotNull(), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))))


def changed(x: SeriesList) -> SeriesList:
    return _window(x, "changed", lambda w: F.coalesce((F.col("value") != _prev(w)).cast("double"), F.lit(0.0)))


def stdev(x: SeriesList, points: int, tolerance: float = 0.1) -> SeriesList:
    def value(w) -> Column:
        rows = w.rowsBetween(-(points - 1), 0)
        n = F.count("value").over(rows)
        return F.when((n > 0) & (n / F.lit(points) >= tolerance), F.stddev_pop("value").over(rows))

    return _window(x, "stddev", value, points)


def keep_last_value(x: SeriesList, limit: float = num.INF) -> SeriesList:
    def value(w) -> Column:
        before = w.rowsBetween(Window.unboundedPreceding, 0)
        at = F.last(F.when(F.col("value").isNotNull(), F.col("step")), ignorenulls=True).over(before)
        near = F.lit(True) if limit == num.INF else (F.col("step") - at) <= int(limit) * x.grid.step
        return F.coalesce("value", F.when(near, F.last("value", ignorenulls=True).over(before)))

    return _window(x, "keepLastValue", value)


def interpolate(x: SeriesList, limit: float = num.INF) -> SeriesList:
    """Straight lines over gaps of at most ``limit`` steps."""
    def value(w) -> Column:
        has = F.when(F.col("value").isNotNull(), F.struct("step", "value"))
        a = F.last(has, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        b = F.first(has, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
        gap = (b["step"] - a["step"]) / x.grid.step - 1
        line = a["value"] + (b["value"] - a["value"]) * (F.col("step") - a["step"]) / (b["step"] - a["step"])
        return F.coalesce("value", F.when(gap <= float(limit), line) if limit != num.INF else line)

    return _window(x, "interpolate", value)


def moving(x: SeriesList, window: str | int, f: str = "avg", x_files: float = 0.0) -> SeriesList:
    """An aggregate over the ``window`` points (or interval) before each step."""
    points = int(window) if not isinstance(window, str) or window.isdigit() else max(1, parse_interval(window) // x.grid.step)
    f = aggregate_name(f)

    def value(w) -> Column:
        rows = w.rowsBetween(-points, -1)
        n = F.count("value").over(rows)
        expr = F.median("value").over(rows) if f == "median" else AGGREGATES[f]().over(rows)
        if f == "median":  # no frames for the median: over the collected window, which has ``points`` values at most
            s = F.array_sort(F.collect_list("value").over(rows))
            half = F.floor(F.size(s) / 2).cast("int")
            expr = F.when(F.size(s) % 2 == 1, F.try_element_at(s, half + 1)).otherwise((F.try_element_at(s, half) + F.try_element_at(s, half + 1)) / 2)
        return F.when((n > 0) & (n / F.lit(points) >= x_files), expr)

    return _window(x, "moving" + {"avg": "Average"}.get(f, f.capitalize()), value, points)


def exponential_moving_average(x: SeriesList, window: str | int) -> SeriesList:
    points = int(window) if not isinstance(window, str) or window.isdigit() else max(1, parse_interval(window) // x.grid.step)
    a = 2.0 / (points + 1)
    steps = F.sort_array(F.collect_list(F.struct("step", "value")))
    rows = x.dense().groupBy("ord", "name").agg(steps.alias("p"))
    folded = F.aggregate("p", F.array().cast("array<struct<step:bigint,value:double>>"), lambda acc, e: F.concat(acc, F.array(F.struct(
        e["step"].alias("step"),
        F.coalesce(a * e["value"] + (1 - a) * F.try_element_at(acc, F.lit(-1))["value"], e["value"], F.try_element_at(acc, F.lit(-1))["value"]).alias("value")))))
    out = rows.select("ord", "name", F.inline(folded))
    return each(x.on(out), "exponentialMovingAverage", F.col("value"), points)


def summarize(x: SeriesList, interval: str, f: str = "sum", align_to_from: bool = False, smart: bool = False) -> SeriesList:
    """Tumbling buckets of ``interval``, aligned to the epoch or to the grid's start."""
    width = parse_interval(interval)
    if width <= 0:
        raise ValueError(f"invalid interval {interval!r}")
    origin = x.grid.start if align_to_from or smart else 0
    bucket = F.floor((F.col("step") - origin) / width) * width + origin
    f = aggregate_name(f or "sum")
    rows = x.frame.where("value is not null").groupBy("ord", "name", bucket.cast("bigint").alias("step"))
    out = rows.agg((F.max_by("value", "step") if f == "last" else AGGREGATES[f]()).alias("value")) if f != "last" else x.frame.where("value is not null").withColumn("b", bucket.cast("bigint")).groupBy("ord", "name", F.col("b")).agg(F.max_by("value", "step").alias("value")).withColumnRenamed("b", "step")
    label = F.concat(F.lit(("smartSummarize(" if smart else "summarize(")), "name", F.lit(f', "{interval}", "{f}"' + (", true" if align_to_from and not smart else "") + ")"))
    start = origin + (x.grid.start - origin) // width * width
    end = origin + (x.grid.end - origin) // width * width
    return SeriesList(out.withColumn("name", label).select("ord", "name", "step", "value"), Grid(start, end, width))


def hitcount(x: SeriesList, interval: str) -> SeriesList:
    """Hits per bucket: values per second times the step's length."""
    scaled = x.on(x.frame.withColumn("value", F.col("value") * (x.grid.step / SECOND)))
    out = summarize(scaled, interval, "sum")
    return renamed(out, F.regexp_replace("name", r'^summarize\((.*), "[^"]*", "sum"\)$', f'hitcount($1,"{interval}")'))


def time_shift(x: SeriesList, by: int) -> SeriesList:
    """Values of a list fetched over the grid moved by ``by``, brought back onto the steps ``by`` later."""
    out = x.frame.withColumn("step", F.col("step") - by)
    g = x.grid
    return SeriesList(each(x.on(out), "timeShift", F.col("value")).frame, Grid(g.start - by, g.end - by, g.step))


def delay(x: SeriesList, steps: int) -> SeriesList:
    g = x.grid
    out = x.frame.withColumn("step", F.col("step") + steps * g.step).where((F.col("step") <= g.end) & (F.col("step") >= g.start))
    return each(x.on(out), "delay", F.col("value"), steps)


def _reduced(x: SeriesList, f: str) -> DataFrame:
    """One number per series."""
    f = aggregate_name(f)
    value = F.max_by("value", "step") if f == "last" else AGGREGATES[f]()
    return x.frame.where("value is not null").groupBy("ord").agg(value.alias("__r"))


def filter_series(x: SeriesList, f: str, op: str, threshold: float) -> SeriesList:
    tests = {"=": "==", "==": "==", "!=": "!=", ">": ">", "<": "<", ">=": ">=", "<=": "<="}
    keep = _reduced(x, f).where(num.COMPARISON[tests[op]](F.col("__r"), F.lit(float(threshold)))).select("ord")
    return x.on(x.frame.join(keep, "ord", "left_semi"))


def _reordered(x: SeriesList, ordered: DataFrame) -> SeriesList:
    """Writes the order of ``ordered`` (sorted over all its partitions, one row per series) into ``ord``."""
    places = ordered.withColumn("__o", F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0")).select("ord", "__o")
    return x.on(x.frame.join(places, "ord").withColumn("ord", F.col("__o")))


def sort_by(x: SeriesList, f: str = "average", reverse: bool = False) -> SeriesList:
    """Orders the list by a number per series; ties keep their order. The order is written into ``ord``."""
    return _reordered(x, _reduced(x, f).orderBy(F.col("__r").desc() if reverse else F.col("__r").asc(), "ord"))


def extreme(x: SeriesList, n: int, f: str = "average", lowest: bool = False) -> SeriesList:
    """The n series with the highest (lowest) number; a global top n, which Spark takes per partition first."""
    r = _reduced(x, f)
    best = r.orderBy(F.col("__r").asc() if lowest else F.col("__r").desc(), "ord").limit(int(n))
    w = Window.orderBy(F.col("__r").asc() if lowest else F.col("__r").desc(), "ord")
    ranks = best.withColumn("__o", F.lpad(F.row_number().over(w).cast("string"), 9, "0")).select("ord", "__o")
    return x.on(x.frame.join(F.broadcast(ranks), "ord").withColumn("ord", F.col("__o")))  # n rows


def sort_by_name(x: SeriesList, natural: bool = False, reverse: bool = False) -> SeriesList:
    key = F.col("name")
    if natural:  # digits padded, so that 9 comes before 10
        key = F.concat_ws("", F.transform(F.regexp_extract_all("name", F.lit(r"(\d+|\D+)"), 1), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)))
    names = x.frame.select("ord", key.alias("__k")).distinct()
    return _reordered(x, names.orderBy(F.col("__k").desc() if reverse else F.col("__k").asc(), "ord"))


def limit(x: SeriesList, n: int) -> SeriesList:
    first = x.frame.select("ord").distinct().orderBy("ord").limit(int(n))
    return x.on(x.frame.join(F.broadcast(first), "ord", "left_semi"))  # n rows


def tail(x: SeriesList, n: int) -> SeriesList:
    last = x.frame.select("ord").distinct().orderBy(F.col("ord").desc()).limit(int(n))
    return x.on(x.frame.join(F.broadcast(last), "ord", "left_semi"))  # n rows


def n_percentile(x: SeriesList, p: float) -> SeriesList:
    """A constant line at each series' percentile."""
    if not 0 <= p <= 100:
        raise ValueError(f"not a percentile: {p}")
    v = x.frame.where("value is not null").groupBy("ord", "name").agg(_percentile_of(F.collect_list("value"), p, False).alias("value"))
    g = x.grid
    out = v.select("ord", "name", F.explode(F.sequence(F.lit(g.start), F.lit(g.start + (g.count - 1) * g.step), F.lit(g.step))).alias("step"), "value")
    return each(x.on(out), "nPercentile", F.col("value"), float(p))


def remove_by_percentile(x: SeriesList, p: float, above: bool) -> SeriesList:
    if not 0 <= p <= 100:
        raise ValueError(f"not a percentile: {p}")
    v = x.frame.where("value is not null").groupBy("ord").agg(_percentile_of(F.collect_list("value"), p, False).alias("__p"))
    both = x.frame.join(v, "ord").where("value <= __p" if above else "value >= __p")
    return each(x.on(both), f"remove{'Above' if above else 'Below'}Percentile", F.col("value"), float(p))


def remove_empty(x: SeriesList, x_files: float = 0.0) -> SeriesList:
    full = x.frame.where("value is not null").groupBy("ord").agg((F.count("value") / F.lit(x.grid.count)).alias("__f")).where(F.col("__f") >= x_files).select("ord")
    return x.on(x.frame.join(full, "ord", "left_semi"))


def sustained(x: SeriesList, threshold: float, interval: str, above: bool = True) -> SeriesList:
    """Keeps values of runs above (below) the threshold that last at least ``interval``."""
    points = max(1, parse_interval(interval) // x.grid.step)
    w = Window.partitionBy("ord", "name").orderBy("step")
    test = F.coalesce((F.col("value") >= threshold) if above else (F.col("value") <= threshold), F.lit(False))
    runs = x.dense().withColumn("__t", test).withColumn("__g", F.sum((~F.col("__t")).cast("int")).over(w))
    kept = runs.where("__t").withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("ord", "name", "__g"))).where(F.col("__n") >= points)
    return each(x.on(kept), "sustainedAbove" if above else "sustainedBelow", F.col("value"), float(threshold))


def sustain(x: SeriesList, interval: str) -> SeriesList:
    """A value only where one has been present for all of the trailing ``interval``: then the least of them."""
    points = max(1, parse_interval(interval) // x.grid.step)
    return _window(x, "sustain", lambda w: F.when(F.count("value").over(w.rowsBetween(-(points - 1), 0)) == points, F.min("value").over(w.rowsBetween(-(points - 1), 0))))


def transform_null(x: SeriesList, default: float = 0.0) -> SeriesList:
    return each(x.on(x.dense()), "transformNull", F.coalesce("value", F.lit(float(default))), float(default))


def is_non_null(x: SeriesList) -> SeriesList:
    return each(x.on(x.dense()), "isNonNull", F.col("value").isNotNull().cast("double"))


def alias_by_node(x: SeriesList, *nodes: int) -> SeriesList:
    return renamed(x, F.concat_ws(".", *(node(i) for i in nodes)))


def alias_sub(x: SeriesList, pattern: str, replacement: str) -> SeriesList:
    return renamed(x, F.regexp_replace("name", pattern, re.sub(r"\\(\d+)", r"$\1", replacement)))


def by_name(x: SeriesList, pattern: str, keep: bool) -> SeriesList:
    test = F.col("name").rlike(pattern)
    return x.where(test if keep else ~test)


def group(lists: list[SeriesList]) -> SeriesList:
    """Lists one after the other."""
    frames = [x.frame.withColumn("ord", F.concat(F.lit(f"{i:06d} "), "ord")) for i, x in enumerate(lists)]
    return lists[0].on(reduce(DataFrame.unionByName, frames)) if len(lists) > 1 else lists[0]


def fallback(x: SeriesList, y: SeriesList) -> SeriesList:
    """y where x has no series at all."""
    some = x.frame.limit(1).groupBy().agg(F.count(F.lit(1)).alias("__n"))
    other = y.frame.crossJoin(F.broadcast(some)).where("__n = 0")  # one row
    return x.on(x.frame.unionByName(other.select("ord", "name", "step", "value")))


def normalize(lists: list[SeriesList], f: str = "avg") -> list[SeriesList]:
    """Lists of different steps brought to the least common multiple by averaging."""
    from math import lcm

    step = lcm(*(x.grid.step for x in lists))
    start, end = min(x.grid.start for x in lists), max(x.grid.end for x in lists)
    start -= start % step
    out = []
    for x in lists:
        if x.grid.step != step:
            at = (F.floor((F.col("step") - start) / step) * step + start).cast("bigint")
            x = SeriesList(x.frame.groupBy("ord", "name", at.alias("step")).agg(AGGREGATES[aggregate_name(f)]().alias("value")), Grid(start, end, step))
        out.append(x)
    return out


def consolidate(x: SeriesList, max_points: int, f: str = "avg") -> SeriesList:
    """At most ``max_points`` points per series: neighbouring steps are combined."""
    per = -(-x.grid.count // max_points)
    if per <= 1:
        return x
    width = per * x.grid.step
    at = (F.floor((F.col("step") - x.grid.start) / width) * width + x.grid.start).cast("bigint")
    f = aggregate_name(f)
    if f in ("last", "pow", "diff"):
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("step", "value"))), lambda e: e["value"])
        fold = {"last": lambda a, v: v, "pow": num.power, "diff": lambda a, v: a - v}[f]
        value = F.aggregate(F.slice(ordered, 2, 1 << 30), ordered[0], fold)
    else:
        value = AGGREGATES[f]()
    out = x.frame.where("value is not null").groupBy("ord", "name", at.alias("__s")).agg(value.alias("value")).withColumnRenamed("__s", "step")
    return SeriesList(out.select("ord", "name", "step", "value"), Grid(x.grid.start, x.grid.end, width))


def path_matches(glob: str) -> str:
    return f"^{glob_to_regex(glob)}$"
