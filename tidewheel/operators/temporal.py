"""From samples to steps: as-of alignment and functions over a trailing window.

A window is closed at both ends, [t - range, t]. Every sample is mapped to the run of steps whose window holds it; samples with the same run of steps
(and within one time cell) are reduced first, so what is multiplied over overlapping windows are partial states, not samples, and a series that holds a
third of all samples is spread over its cells. There is no join with the grid and no sort of a whole series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.operators.frames import SECOND, Grid, label_key

#: Samples of a series that are put in order together lie within a window's 16th, but at least this many microseconds.
CELL = 300 * SECOND


def _covered(raw: DataFrame, grid: Grid, width: int) -> DataFrame:
    """Adds k_lo and k_hi, the first and last step whose window [t - width, t] holds the sample."""
    ts = F.col("ts")
    near = raw.where((ts >= grid.start - width) & (ts <= grid.start + (grid.count - 1) * grid.step))
    low = F.expr(f"greatest(0L, (ts - {grid.start}L + {grid.step - 1}L) div {grid.step}L)")
    high = F.expr(f"least({grid.count - 1}L, (ts + {width}L - {grid.start}L) div {grid.step}L)")
    return near.withColumn("k_lo", low).withColumn("k_hi", high).where("k_lo <= k_hi")


def _on_steps(partial: DataFrame) -> DataFrame:
    return partial.withColumn("k", F.explode(F.sequence("k_lo", "k_hi"))).drop("k_lo", "k_hi")


def _labelled(values: DataFrame, dim: DataFrame, grid: Grid) -> DataFrame:
    step = (F.col("k") * grid.step + grid.start).alias("step")
    return values.where("value is not null").join(dim, "sid").select("labels", step, F.col("value").cast("double").alias("value"))


def align(raw: DataFrame, dim: DataFrame, grid: Grid, lookback: int) -> DataFrame:
    """The latest sample within [t - lookback, t] for each series and step t: an as-of join without a join."""
    last = _covered(raw, grid, lookback).groupBy("sid", "k_lo", "k_hi").agg(F.max(F.struct("ts", "value")).alias("last"))
    values = _on_steps(last).groupBy("sid", "k").agg(F.max("last")["value"].alias("value"))
    return _labelled(values, dim, grid)


def carry_forward(vector: DataFrame, grid: Grid) -> DataFrame:
    """Each series from its first step on, holding the last value where one is absent. A series has at most the grid's steps."""
    end = grid.start + (grid.count - 1) * grid.step
    w = Window.partitionBy("__k").orderBy("step")
    rows = vector.withColumn("__k", label_key(F.col("labels"))).withColumn("__next", F.coalesce(F.lead("step").over(w) - grid.step, F.lit(end)))
    return rows.select("labels", F.explode(F.sequence("step", "__next", F.lit(grid.step))).alias("step"), "value")


def accumulate(raw: DataFrame, dim: DataFrame, grid: Grid, width: int) -> DataFrame:
    """All samples of each step's window, in time order: labels, step, points array<struct<ts, value>>."""
    each = _on_steps(_covered(raw, grid, width)).groupBy("sid", "k").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("points"))
    return each.join(dim, "sid").select("labels", (F.col("k") * grid.step + grid.start).alias("step"), "points")


# functions whose partial states merge in any order: name -> {partial: (aggregate, how partials merge)}, final value
_DECOMPOSED: dict[str, tuple[dict[str, tuple[Callable, Callable]], Callable[[], Column]]] = {
    "sum_over_time": ({"s": (lambda: F.sum("value"), F.sum)}, lambda: F.col("s")),
    "count_over_time": ({"c": (lambda: F.count("value"), F.sum)}, lambda: F.col("c")),
    "avg_over_time": ({"s": (lambda: F.sum("value"), F.sum), "c": (lambda: F.count("value"), F.sum)}, lambda: F.col("s") / F.col("c")),
    "min_over_time": ({"m": (lambda: F.min("value"), F.min)}, lambda: F.col("m")),
    "max_over_time": ({"m": (lambda: F.max("value"), F.max)}, lambda: F.col("m")),
    "last_over_time": ({"l": (lambda: F.max(F.struct("ts", "value")), F.max)}, lambda: F.col("l.value")),
    "present_over_time": ({"c": (lambda: F.count("value"), F.sum)}, lambda: F.lit(1.0)),
}


def _decomposed(raw: DataFrame, grid: Grid, width: int, name: str) -> DataFrame:
    partials, value = _DECOMPOSED[name]
    partial = _covered(raw, grid, width).groupBy("sid", "k_lo", "k_hi").agg(*(a().alias(n) for n, (a, _) in partials.items()))
    merged = _on_steps(partial).groupBy("sid", "k").agg(*(m(n).alias(n) for n, (_, m) in partials.items()))
    return merged.select("sid", "k", value().alias("value"))


def _moments(raw: DataFrame, grid: Grid, width: int) -> DataFrame:
    """Count, means and central moments of time (seconds from the grid's start) and value in each window: n, mt, mv, tt, tv, vv.

    Samples are reduced to moments by the run of steps they belong to; a window's few states (two for each step that its width spans) are combined about
    their common mean, so nothing cancels.
    """
    t = (F.col("ts") - grid.start) / SECOND
    v = F.col("value")
    partial = _covered(raw, grid, width).groupBy("sid", "k_lo", "k_hi").agg(F.count(v).alias("n"), F.avg(t).alias("mt"), F.avg(v).alias("mv"), F.regr_sxx(v, t).alias("tt"), F.regr_sxy(v, t).alias("tv"), F.regr_syy(v, t).alias("vv"))
    states = _on_steps(partial).groupBy("sid", "k").agg(F.collect_list(F.struct("n", "mt", "mv", "tt", "tv", "vv")).alias("s"), F.sum("n").alias("n"))

    def total(f: Callable[[Column], Column]) -> Column:
        return F.aggregate("s", F.lit(0.0), lambda a, x: a + f(x))

    means = states.withColumn("mt", total(lambda x: x["n"] * x["mt"]) / F.col("n")).withColumn("mv", total(lambda x: x["n"] * x["mv"]) / F.col("n"))
    off = {"t": lambda x: x["mt"] - F.col("mt"), "v": lambda x: x["mv"] - F.col("mv")}
    return means.select("sid", "k", "n", "mt", "mv", *(total(lambda x, a=a, b=b: x[a + b] + x["n"] * off[a](x) * off[b](x)).alias(a + b) for a, b in ("tt", "tv", "vv")))


def _direct(raw: DataFrame, grid: Grid, width: int, value: Column) -> DataFrame:
    """For functions of all samples of the window: ``value`` is an aggregate over ts, value and t (the step's time)."""
    each = _on_steps(_covered(raw, grid, width)).withColumn("t", F.col("k") * grid.step + grid.start)
    return each.groupBy("sid", "k").agg(value.alias("value"))


def _ordered(raw: DataFrame, grid: Grid, width: int) -> DataFrame:
    """Merged states of ordered windows: first, last and last-but-one sample, count, resets, changes and reset correction.

    Samples are ordered within cells only; a cell's state is the concatenation monoid's element, and a window's few cells are folded in order.
    """
    cell = F.expr(f"ts div {max(CELL, width // 16)}L")
    w = Window.partitionBy("sid", "k_lo", "k_hi", "cell").orderBy("ts")
    rows = _covered(raw, grid, width).withColumn("cell", cell).withColumn("p_ts", F.lag("ts").over(w)).withColumn("p_v", F.lag("value").over(w))
    state = rows.groupBy("sid", "k_lo", "k_hi", "cell").agg(
        F.min(F.struct("ts", "value")).alias("f"),
        F.max(F.struct("ts", "value", "p_ts", "p_v")).alias("l"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("value") < F.col("p_v"), F.col("p_v"))), F.lit(0.0)).alias("corr"),
        F.count(F.when(F.col("value") < F.col("p_v"), 1)).alias("resets"),
        F.count(F.when(F.col("value") != F.col("p_v"), 1)).alias("changes"),
    )
    states = F.sort_array(F.collect_list(F.struct("f", "l", "n", "corr", "resets", "changes")))
    folded = _on_steps(state).groupBy("sid", "k").agg(states.alias("s"))
    return folded.withColumn("w", F.expr("""
        aggregate(slice(s, 2, size(s)), s[0], (a, b) -> named_struct(
            'f', a.f,
            'l', named_struct('ts', b.l.ts, 'value', b.l.value, 'p_ts', coalesce(b.l.p_ts, a.l.ts), 'p_v', coalesce(b.l.p_v, a.l.value)),
            'n', a.n + b.n,
            'corr', a.corr + b.corr + if(b.f.value < a.l.value, a.l.value, 0D),
            'resets', a.resets + b.resets + if(b.f.value < a.l.value, 1L, 0L),
            'changes', a.changes + b.changes + if(b.f.value != a.l.value, 1L, 0L)))""")).select("sid", "k", "w")  # fmt: skip


def extrapolated(grid: Grid, width: int, counter: bool, per_second: bool) -> Column:
    """rate, increase and delta of a window state ``w``: the observed change stretched to the window's ends.

    An end is reached fully if it lies within 1.1 average gaps of the outermost sample, else by half a gap; a counter isn't stretched below zero.
    """
    t = F.col("k") * grid.step + grid.start
    first, last = F.col("w.f.value"), F.col("w.l.value")
    covered = (F.col("w.l.ts") - F.col("w.f.ts")) / SECOND
    to_start = (F.col("w.f.ts") - (t - width)) / SECOND
    to_end = (t - F.col("w.l.ts")) / SECOND
    gap = covered / (F.col("w.n") - 1)
    change = last - first + (F.col("w.corr") if counter else F.lit(0.0))
    if counter:
        zero = covered * (first / F.when(change > 0, change))
        to_start = F.when((change > 0) & (first >= 0) & (zero < to_start), zero).otherwise(to_start)
    stretched = covered + F.when(to_start < gap * 1.1, to_start).otherwise(gap / 2) + F.when(to_end < gap * 1.1, to_end).otherwise(gap / 2)
    value = change * (stretched / F.when(covered != 0, covered))
    return F.when(F.col("w.n") > 1, value / (width / SECOND) if per_second else value)


def _last_two(rate: bool) -> Column:
    before, last = F.col("w.l.p_v"), F.col("w.l.value")
    seconds = (F.col("w.l.ts") - F.col("w.l.p_ts")) / SECOND
    if not rate:
        return F.when(F.col("w.n") > 1, last - before)
    return F.when((F.col("w.n") > 1) & (seconds > 0), F.when(last < before, last).otherwise(last - before) / F.when(seconds > 0, seconds))


def _holt_winters(sf: float, tf: float) -> Column:
    """Double exponential smoothing folded over the window's values in time order."""
    for what, x in (("smoothing", sf), ("trend", tf)):
        if not 0 < x < 1:
            raise ValueError(f"the {what} factor must lie between 0 and 1")
    values = F.transform(F.sort_array(F.collect_list(F.struct("ts", "value"))), lambda p: p["value"])

    def step(a: Column, x: Column) -> Column:
        trend = F.when(a["i"] == 0, a["trend"]).otherwise(tf * (a["cur"] - a["prev"]) + (1 - tf) * a["trend"])
        return F.struct(a["cur"].alias("prev"), (sf * x + (1 - sf) * (a["cur"] + trend)).alias("cur"), trend.alias("trend"), (a["i"] + 1).alias("i"))

    start = F.struct(F.lit(0.0).alias("prev"), values[0].alias("cur"), (F.get(values, F.lit(1)) - values[0]).alias("trend"), F.lit(0).alias("i"))
    return F.when(F.count(F.lit(1)) > 1, F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), start, step, lambda a: a["cur"]))


def _quantile(q: float) -> Column:
    if q != q:
        return F.lit(float("nan")) + F.max("value") * 0
    if not 0 <= q <= 1:
        return F.when(F.count(F.lit(1)) > 0, F.lit(float("-inf") if q < 0 else float("inf")))
    return F.percentile("value", F.lit(q))


def over_time(raw: DataFrame, dim: DataFrame, grid: Grid, width: int, name: str, *args: float) -> DataFrame:
    """A range-vector function by name; a step without enough samples has no row."""
    if name in _DECOMPOSED:
        values = _decomposed(raw, grid, width, name)
    elif name in ("stddev_over_time", "stdvar_over_time", "deriv", "predict_linear"):
        variance = F.col("vv") / F.col("n")
        slope = F.col("tv") / F.when(F.col("tt") != 0, F.col("tt"))
        value = {
            "stdvar_over_time": lambda: variance,
            "stddev_over_time": lambda: F.sqrt(variance),
            "deriv": lambda: slope,
            "predict_linear": lambda: F.col("mv") + slope * (F.col("k") * grid.step / SECOND + args[0] - F.col("mt")),
        }[name]()
        values = _moments(raw, grid, width).where("n > 1").select("sid", "k", value.alias("value"))
    elif name == "quantile_over_time":
        values = _direct(raw, grid, width, _quantile(args[0]))
    elif name == "holt_winters":
        values = _direct(raw, grid, width, _holt_winters(*args))
    else:
        states = _ordered(raw, grid, width)
        value = {
            "rate": lambda: extrapolated(grid, width, True, True),
            "increase": lambda: extrapolated(grid, width, True, False),
            "delta": lambda: extrapolated(grid, width, False, False),
            "irate": lambda: _last_two(True),
            "idelta": lambda: _last_two(False),
            "resets": lambda: F.when(F.col("w.n") > 1, F.col("w.resets").cast("double")),
            "changes": lambda: F.when(F.col("w.n") > 1, F.col("w.changes").cast("double")),
        }[name]()
        values = states.select("sid", "k", value.alias("value"))
    return _labelled(values, dim, grid)


RANGE_FUNCTIONS = (*_DECOMPOSED, "stddev_over_time", "stdvar_over_time", "quantile_over_time", "deriv", "predict_linear", "holt_winters", "rate", "increase", "delta", "irate", "idelta", "resets", "changes")
