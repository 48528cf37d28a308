"""Parsing and planning of dotted-path targets: ``alias(sumSeries(a.*.b), 'x')``."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import graphite as g
from tidewheel.functions import num
from tidewheel.functions.paths import parse_interval, parse_time, part_label, path_matchers, split_path
from tidewheel.operators.frames import SECOND, Grid, SeriesSource

TOKEN = re.compile(r"""
    (?P<space>\s+)
  | (?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
  | (?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?=\s*[,)]|\s*$))
  | (?P<op>[(),=])
  | (?P<path>(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}|\[[^\]]*\]|[^\s(),={}'"\[\]])+)
""", re.VERBOSE)  # fmt: skip


class TargetError(ValueError):
    pass


@dataclass
class Path:
    text: str


@dataclass
class Function:
    name: str
    args: list
    kwargs: dict


def parse_target(text: str) -> object:
    tokens, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise TargetError(f"unexpected {text[at]!r} at {at} in {text!r}")
        if m.lastgroup != "space":
            tokens.append((m.lastgroup, m.group()))
        at = m.end()
    tokens.append(("end", ""))
    at = 0

    def peek(value: str) -> bool:
        return tokens[at] == ("op", value)

    def expression() -> object:
        nonlocal at
        kind, word = tokens[at]
        at += 1
        if kind == "string":
            return re.sub(r"\\(.)", r"\1" if word[0] in "\"'" else "", word[1:-1]) if "\\" in word and not re.search(r"\\[\dswdSWDbB.]", word) else word[1:-1]
        if kind == "number":
            return float(word) if re.search(r"[.eE]", word) else int(word)
        if kind != "path":
            raise TargetError(f"unexpected {word or 'end'!r} in {text!r}")
        if word.lower() in ("true", "false") and not peek("("):
            return word.lower() == "true"
        if word in ("None", "null"):
            return None
        if not peek("("):
            return Path(word)
        at += 1
        f = Function(word, [], {})
        while not peek(")"):
            if tokens[at][0] == "path" and tokens[at + 1] == ("op", "="):
                key = tokens[at][1]
                at += 2
                f.kwargs[key] = expression()
            else:
                f.args.append(expression())
            if peek(","):
                at += 1
            elif not peek(")"):
                raise TargetError(f"expected , or ) before {tokens[at][1] or 'the end'!r} in {text!r}")
        at += 1
        return f

    tree = expression()
    if tokens[at][0] != "end":
        raise TargetError(f"unexpected {tokens[at][1]!r} in {text!r}")
    return tree


L = g.SeriesList


def _moving(f: str) -> Callable:
    return lambda x, window, x_files=0.0: g.moving(x, window, f, x_files)


def _combined(f: str) -> Callable:
    return lambda *x: g.combine(g.group(list(x)), f, f"{f}Series")


def _value(name: str, value: Callable) -> Callable:
    return lambda x, *args: g.each(x, name, value(F.col("value"), *args), *(float(a) if isinstance(a, (int, float)) else a for a in args))


#: Functions of series lists by name. A list argument arrives as a SeriesList, the rest as Python values.
FUNCTIONS: dict[str, Callable] = {
    **{f"{f}Series": _combined(f) for f in ("sum", "average", "min", "max", "multiply", "pow", "last", "diff", "median", "stddev", "count", "rangeOf")},
    **{short: _combined(f) for short, f in (("sum", "sum"), ("avg", "average"), ("min", "min"), ("max", "max"), ("diff", "diff"))},
    "aggregate": lambda x, f, xFilesFactor=None: g.covered(g.combine(x, f, f"{f}Series"), x, xFilesFactor or 0.0),
    "percentileOfSeries": lambda x, n, interpolate=False: g.percentile_of_series(x, n, interpolate),
    "groupByNode": lambda x, n, f="average": g.group_by_nodes(x, f, n),
    "groupByNodes": lambda x, f, *nodes: g.group_by_nodes(x, f, *nodes),
    "groupByTags": lambda x, f, *nodes: g.group_by_nodes(x, f, *nodes),
    "sumSeriesWithWildcards": lambda x, *p: g.with_wildcards(x, "sum", *p),
    "averageSeriesWithWildcards": lambda x, *p: g.with_wildcards(x, "avg", *p),
    "multiplySeriesWithWildcards": lambda x, *p: g.with_wildcards(x, "multiply", *p),
    "aggregateWithWildcards": lambda x, f, *p: g.with_wildcards(x, f, *p),
    "divideSeries": lambda x, y: g.divide(x, y),
    "divideSeriesLists": lambda x, y: g.divide(x, y, pairwise=True),
    "weightedAverage": lambda x, w, n: g.weighted_average(x, w, n),
    "asPercent": lambda x, total=None: g.as_percent(x, total),
    "scale": _value("scale", lambda v, k: v * float(k)),
    "offset": _value("offset", lambda v, k: v + float(k)),
    "absolute": _value("absolute", lambda v: F.abs(v)),
    "squareRoot": _value("squareRoot", lambda v: F.when(v >= 0, F.sqrt(F.when(v >= 0, v)))),
    "logarithm": lambda x, base=10: g.each(x, "logarithm", F.when(F.col("value") > 0, F.log(F.when(F.col("value") > 0, F.col("value"))) / F.log(F.lit(float(base)))), base),
    "invert": _value("invert", lambda v: F.when(v != 0, 1 / F.when(v != 0, v))),
    "scaleToSeconds": lambda x, seconds: g.each(x, "scaleToSeconds", F.col("value") * (float(seconds) * SECOND / x.grid.step), seconds),
    "removeAboveValue": _value("removeAboveValue", lambda v, n: F.when(v <= float(n), v)),
    "removeBelowValue": _value("removeBelowValue", lambda v, n: F.when(v >= float(n), v)),
    "transformNull": lambda x, default=0.0: g.transform_null(x, default),
    "isNonNull": lambda x: g.is_non_null(x),
    "derivative": lambda x: g.derivative(x),
    "nonNegativeDerivative": lambda x, maxValue=None: g.non_negative_derivative(x, maxValue),
    "perSecond": lambda x: g.per_second(x),
    "integral": lambda x: g.integral(x),
    "changed": lambda x: g.changed(x),
    "stdev": lambda x, points, windowTolerance=0.1: g.stdev(x, points, windowTolerance),
    "keepLastValue": lambda x, limit=num.INF: g.keep_last_value(x, limit),
    "interpolate": lambda x, limit=num.INF: g.interpolate(x, limit),
    "movingAverage": _moving("avg"), "movingMedian": _moving("median"), "movingSum": _moving("sum"), "movingMin": _moving("min"), "movingMax": _moving("max"),
    "movingWindow": lambda x, window, f="average", x_files=0.0: g.moving(x, window, f, x_files),
    "exponentialMovingAverage": lambda x, window: g.exponential_moving_average(x, window),
    "summarize": lambda x, interval, f="sum", alignToFrom=False: g.summarize(x, interval, f, alignToFrom),
    "smartSummarize": lambda x, interval, f="sum": g.summarize(x, interval, f, smart=True),
    "hitcount": lambda x, interval: g.hitcount(x, interval),
    "delay": lambda x, steps: g.delay(x, steps),
    "nPercentile": lambda x, n: g.n_percentile(x, n),
    "removeAbovePercentile": lambda x, n: g.remove_by_percentile(x, n, True),
    "removeBelowPercentile": lambda x, n: g.remove_by_percentile(x, n, False),
    "removeEmptySeries": lambda x, xFilesFactor=0.0: g.remove_empty(x, xFilesFactor),
    "filterSeries": lambda x, f, op, n: g.filter_series(x, f, op, n),
    "averageAbove": lambda x, n: g.filter_series(x, "avg", ">", n), "averageBelow": lambda x, n: g.filter_series(x, "avg", "<=", n),
    "currentAbove": lambda x, n: g.filter_series(x, "last", ">", n), "currentBelow": lambda x, n: g.filter_series(x, "last", "<=", n),
    "maximumAbove": lambda x, n: g.filter_series(x, "max", ">", n), "maximumBelow": lambda x, n: g.filter_series(x, "max", "<=", n),
    "minimumAbove": lambda x, n: g.filter_series(x, "min", ">", n), "minimumBelow": lambda x, n: g.filter_series(x, "min", "<=", n),
    "sortBy": lambda x, f="average", reverse=False: g.sort_by(x, f, reverse),
    "sortByName": lambda x, natural=False, reverse=False: g.sort_by_name(x, natural, reverse),
    "sortByTotal": lambda x: g.sort_by(x, "sum", True), "sortByMaxima": lambda x: g.sort_by(x, "max", True), "sortByMinima": lambda x: g.sort_by(x, "min"),
    "highest": lambda x, n=1, f="average": g.extreme(x, n, f), "lowest": lambda x, n=1, f="average": g.extreme(x, n, f, True),
    "highestCurrent": lambda x, n=1: g.extreme(x, n, "last"), "highestAverage": lambda x, n=1: g.extreme(x, n, "avg"), "highestMax": lambda x, n=1: g.extreme(x, n, "max"),
    "lowestCurrent": lambda x, n=1: g.extreme(x, n, "last", True), "lowestAverage": lambda x, n=1: g.extreme(x, n, "avg", True),
    "limit": lambda x, n: g.limit(x, n), "head": lambda x, n: g.limit(x, n), "tail": lambda x, n: g.tail(x, n),
    "exclude": lambda x, pattern: g.by_name(x, pattern, False), "grep": lambda x, pattern: g.by_name(x, pattern, True),
    "group": lambda *x: g.group(list(x)),
    "fallbackSeries": lambda x, y: g.fallback(x, y),
    "sustainedAbove": lambda x, n, interval: g.sustained(x, n, interval, True), "sustainedBelow": lambda x, n, interval: g.sustained(x, n, interval, False),
    "sustain": lambda x, interval: g.sustain(x, interval),
    "alias": lambda x, name: g.renamed(x, F.lit(name)),
    "aliasByNode": lambda x, *n: g.alias_by_node(x, *n), "aliasByTags": lambda x, *n: g.alias_by_node(x, *n),
    "aliasByMetric": lambda x: g.alias_by_node(x, -1),
    "aliasSub": lambda x, pattern, to: g.alias_sub(x, pattern, to),
}
FUNCTIONS["movingAverage"], FUNCTIONS["averageSeries"] = _moving("avg"), _combined("average")


@dataclass
class Renderer:
    """Targets over a store whose series carry their path parts as labels."""

    source: SeriesSource
    now: float | None = None

    @property
    def spark(self) -> SparkSession:
        return self.source.rows.sparkSession

    def fetch(self, glob: str, grid: Grid, f: str = "last") -> L:
        """Series of a path glob, on the steps of the grid: of the samples in [step, step + width) the last, or another aggregate."""
        raw, dim = self.source.select(path_matchers(glob), grid.start, grid.start + grid.count * grid.step - 1)
        at = (F.floor((F.col("ts") - grid.start) / grid.step) * grid.step + grid.start).cast("bigint").alias("step")
        value = F.max_by("value", "ts") if f == "last" else g.AGGREGATES[g.aggregate_name(f)]()
        points = raw.groupBy("sid", at).agg(value.alias("value"))
        name = F.concat_ws(".", *(F.try_element_at("labels", F.lit(part_label(i))) for i in range(len(split_path(glob)))))
        named = points.join(dim.select("sid", name.alias("name")), "sid")
        return L(named.select(F.col("name").alias("ord"), "name", "step", "value"), grid)

    def plan(self, e: object, grid: Grid) -> object:
        if isinstance(e, Path):
            return self.fetch(e.text, grid)
        if not isinstance(e, Function):
            return e
        if e.name in ("timeShift", "timeshift"):
            by = parse_interval(e.args[1])
            by = -abs(by) if not e.args[1].startswith("+") else by
            return g.time_shift(self.list(e.args[0], grid.shifted(by)), by)
        if e.name == "identity":
            return self._line(e.args[0], grid, F.col("step") / SECOND)
        if e.name in ("constantLine", "threshold", "constantSeries"):
            return self._line(f"{float(e.args[0]):g}", grid, F.lit(float(e.args[0])))
        if e.name in ("time", "timeFunction"):
            return self._line(e.args[0], grid, F.col("step") / SECOND)
        if e.name == "applyByNode":
            return self._apply_by_node(e, grid)
        if e.name not in FUNCTIONS:
            raise TargetError(f"unknown function {e.name}")
        args = [self.plan(a, grid) for a in e.args]
        kwargs = {k: self.plan(a, grid) for k, a in e.kwargs.items()}
        lists = [a for a in args if isinstance(a, L)]
        if len({x.grid for x in lists}) > 1:
            same = iter(g.normalize(lists))
            args = [next(same) if isinstance(a, L) else a for a in args]
        return FUNCTIONS[e.name](*args, **kwargs)

    def list(self, e: object, grid: Grid) -> L:
        x = self.plan(e, grid)
        if not isinstance(x, L):
            raise TargetError("a series list is needed here")
        return x

    def _line(self, name: str, grid: Grid, value) -> L:
        rows = grid.frame(self.spark).select(F.lit(name).alias("ord"), F.lit(name).alias("name"), "step", value.cast("double").alias("value"))
        return L(rows, grid)

    def _apply_by_node(self, e: Function, grid: Grid) -> L:
        """The template once per distinct prefix of the first n+1 parts; the prefixes are the only thing looked up while planning."""
        path, n, template, *rest = e.args
        _, dim = self.source.select(path_matchers(path.text))
        prefix = F.concat_ws(".", *(F.try_element_at("labels", F.lit(part_label(i))) for i in range(int(n) + 1)))
        prefixes = sorted(r[0] for r in dim.select(prefix).distinct().collect())
        out = []
        for p in prefixes:
            x = self.list(parse_target(template.replace("%", p)), grid)
            out.append(g.renamed(x, F.lit(rest[0].replace("%", p))) if rest else x)
        return g.group(out) if out else L(self.fetch(path.text, grid).frame.limit(0), grid)

    def render(self, target: str, start: str | int, until: str | int, step: int, max_points: int | None = None) -> DataFrame:
        """name, step, value of a target between two times (references or microseconds), in list order."""
        low = parse_time(start, self.now) if isinstance(start, str) else start
        high = parse_time(until, self.now) if isinstance(until, str) else until
        low -= low % step
        x = self.list(parse_target(target), Grid(low, max(low, high - 1), step))
        if max_points:
            x = g.consolidate(x, max_points)
        return x.frame.where("value is not null")

    def find(self, glob: str) -> DataFrame:
        """The next level of the path tree: text (last part), path, leaf."""
        parts = split_path(glob)
        _, dim = self.source.select(path_matchers(glob)[:-1])
        labels = [F.try_element_at("labels", F.lit(part_label(i))) for i in range(len(parts) + 1)]
        rows = dim.select(F.concat_ws(".", *labels[:-1]).alias("path"), labels[-2].alias("text"), labels[-1].isNull().alias("leaf"))
        return rows.distinct()
