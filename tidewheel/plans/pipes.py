"""The pipeline language: ``fetch name:cpu host:web* | sum dc | scale 2 | > 5``, with macros and nested pipelines.

Each stage is a function of the pipeline's series so far. Series carry labels, so grouping goes by tag names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.functions import graphite as g
from tidewheel.functions import num
from tidewheel.functions.paths import glob_to_regex, parse_interval
from tidewheel.operators import temporal, vectors
from tidewheel.operators.frames import NAME, SECOND, Grid, Matcher, SeriesSource, keep_labels, label_key, series_text

TOKEN = re.compile(r"""
    (?P<space>(?:\s+|\#[^\n]*)+)
  | (?P<string>"[^"]*")
  | (?P<op><=|<|==|!=|>=|>)
  | (?P<mark>[|();=:])
  | (?P<word>!?[-\w./\\{}\[\]*?,^$%]+)
""", re.VERBOSE)  # fmt: skip
NUMBER = re.compile(r"-?(\d+|\d*\.\d+)$")


class PipeError(ValueError):
    pass


@dataclass
class Stage:
    name: str
    args: list = field(default_factory=list)
    kwargs: list[tuple[str, object]] = field(default_factory=list)


@dataclass
class Pipeline:
    stages: list[Stage | Pipeline]


def parse(text: str) -> Pipeline:
    """Macro definitions ``name = pipeline;`` are expanded where a stage has their name."""
    tokens, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise PipeError(f"unexpected {text[at]!r} at {at} in {text!r}")
        if m.lastgroup != "space":
            tokens.append((m.lastgroup, m.group()))
        at = m.end()
    tokens.append(("end", ""))
    at = 0
    macros: dict[str, Pipeline] = {}

    def is_mark(value: str, ahead: int = 0) -> bool:
        return tokens[min(at + ahead, len(tokens) - 1)] == ("mark", value)

    def pipeline() -> Pipeline:
        nonlocal at
        stages = [stage()]
        while is_mark("|"):
            at += 1
            stages.append(stage())
        return Pipeline(stages)

    def nested() -> Pipeline:
        nonlocal at
        at += 1
        p = pipeline()
        if not is_mark(")"):
            raise PipeError(f"expected ) in {text!r}")
        at += 1
        return p

    def argument() -> object:
        nonlocal at
        if is_mark("("):
            return nested()
        kind, word = tokens[at]
        at += 1
        if kind == "string":
            return word[1:-1]
        if kind != "word":
            raise PipeError(f"unexpected {word or 'end'!r} in {text!r}")
        if word in ("true", "false"):
            return word == "true"
        if NUMBER.match(word):
            return float(word)
        return word

    def stage() -> Stage | Pipeline:
        nonlocal at
        if is_mark("("):
            return nested()
        kind, word = tokens[at]
        if kind not in ("word", "op"):
            raise PipeError(f"expected a function, found {word or 'the end'!r} in {text!r}")
        at += 1
        s = Stage(word)
        while tokens[at][0] in ("word", "string") or is_mark("("):
            if tokens[at][0] == "word" and is_mark(":", 1):
                key = tokens[at][1]
                at += 2
                s.kwargs.append((key, argument()))
            else:
                s.args.append(argument())
        return macros[word] if word in macros and not s.args and not s.kwargs else s

    while tokens[at][0] == "word" and is_mark("=", 1):
        name = tokens[at][1]
        at += 2
        macros[name] = pipeline()
        if not is_mark(";"):
            raise PipeError("a macro ends with ;")
        at += 1
    tree = pipeline()
    if tokens[at][0] != "end":
        raise PipeError(f"unexpected {tokens[at][1]!r} in {text!r}")
    return tree


@dataclass
class Pipes:
    source: SeriesSource
    lookback: int = temporal.CELL

    @property
    def spark(self) -> SparkSession:
        return self.source.rows.sparkSession

    def query(self, text: str, start: float, end: float, step: float) -> DataFrame:
        """labels, step, value."""
        return self.run(parse(text), Grid.seconds(start, end, step))

    def run(self, p: Pipeline, grid: Grid, x: DataFrame | None = None) -> DataFrame:
        """``timeshift`` evaluates what stands before it over the grid moved back and brings the result forward."""
        shifts = [i for i, s in enumerate(p.stages) if isinstance(s, Stage) and s.name == "timeshift"]
        if shifts and x is None:
            last = shifts[-1]
            by = abs(parse_interval(p.stages[last].args[0]))
            x = self.run(Pipeline(p.stages[:last]), grid.shifted(-by)).withColumn("step", F.col("step") + by)
            p = Pipeline(p.stages[last + 1 :])
        for s in p.stages:
            x = self.run(s, grid, x) if isinstance(s, Pipeline) else self.stage(s, grid, x)
        return x

    # list functions work on (ord, name); labels travel beside as a map

    def _as_list(self, x: DataFrame, grid: Grid) -> tuple[g.SeriesList, DataFrame]:
        keyed = x.withColumn("ord", label_key(F.col("labels")))
        return g.SeriesList(keyed.select("ord", F.col("ord").alias("name"), "step", "value"), grid), keyed.select("ord", "labels").dropDuplicates(["ord"])

    def _through(self, f: Callable[[g.SeriesList], g.SeriesList], x: DataFrame, grid: Grid) -> DataFrame:
        series, labels = self._as_list(x, grid)
        # functions may number ``ord`` anew, so labels are found by the original key, kept in the name
        plain = g.SeriesList(series.frame, grid)
        out = f(plain).frame
        key = F.col("ord")
        return out.withColumn("__key", key).join(labels.withColumnRenamed("ord", "__key"), "__key").where("value is not null").select("labels", "step", "value")

    def _fetch(self, s: Stage, grid: Grid) -> DataFrame:
        matchers = []
        for key, value in s.kwargs:
            value = str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)
            key = NAME if key == "name" else key
            negated, value = value.startswith("!"), value.removeprefix("!")
            if re.search(r"[*?\[\]{}]", value):
                matchers.append(Matcher(key, "!~" if negated else "=~", glob_to_regex(value, "\\n") if "." not in value else glob_to_regex(value)))
            else:
                matchers.append(Matcher(key, "!=" if negated else "=", value))
        raw, dim = self.source.select(matchers, grid.start - self.lookback, grid.end)
        return temporal.align(raw, dim, grid, self.lookback)

    def stage(self, s: Stage, grid: Grid, x: DataFrame | None) -> DataFrame:
        if s.name == "fetch":
            return self._fetch(s, grid)
        args = [self.run(a, grid) if isinstance(a, Pipeline) else a for a in s.args]
        if s.name in ("constantLine", "identity"):
            value = F.lit(float(args[0])) if s.name == "constantLine" else F.col("step") / SECOND
            return vectors.constant(grid, self.spark, value)
        if s.name in ("execute", "exec"):
            return args[0]
        if x is None:
            raise PipeError(f"{s.name} needs a pipeline before it")
        f = STAGES.get(s.name)
        if f is None:
            raise PipeError(f"unknown function {s.name}")
        return f(self, grid, x, *args)


def _values(f: Callable[..., Column]) -> Callable:
    return lambda p, grid, x, *a: x.withColumn("value", f(F.col("value"), *a).cast("double")).where("value is not null")


def _compare(op: str) -> Callable:
    return lambda p, grid, x, n: x.where(num.COMPARISON[op](F.col("value"), F.lit(float(n))))


def _across(f: str) -> Callable:
    def run(p, grid, x, *tags):
        if f == "multiply":
            return x.withColumn("labels", vectors.group_labels(list(tags), None)).groupBy("labels", "step").agg(F.product("value").alias("value"))
        if f == "range":
            return x.withColumn("labels", vectors.group_labels(list(tags), None)).groupBy("labels", "step").agg((F.max("value") - F.min("value")).alias("value"))
        if f == "diff":
            y = x.withColumn("__g", label_key(vectors.group_labels(list(tags), None))).withColumn("__k", label_key(F.col("labels"))).withColumn("__first", F.min("__k").over(Window.partitionBy("__g")))
            return y.withColumn("labels", vectors.group_labels(list(tags), None)).groupBy("labels", "step").agg(F.sum(F.when(F.col("__k") == F.col("__first"), F.col("value")).otherwise(-F.col("value"))).alias("value"))
        return vectors.aggregate(x, f, list(tags))

    return run


def _listed(f: Callable) -> Callable:
    return lambda p, grid, x, *a: p._through(lambda s: f(s, *a), x, grid)


def _sorted(p, grid, x, how="avg", order="desc"):
    """Order of series by a number per series; rows come out ordered."""
    r = x.groupBy("labels").agg((F.max_by("value", "step") if how == "current" else g.AGGREGATES[g.aggregate_name(how)]()).alias("__r"))
    both = x.withColumn("__k", label_key(F.col("labels"))).join(r.select(label_key(F.col("labels")).alias("__k"), "__r"), "__k")
    return both.orderBy(F.col("__r").asc() if order == "asc" else F.col("__r").desc(), "__k", "step").select("labels", "step", "value")


def _first_series(p, grid, x, n, last=False):
    keyed = x.withColumn("__k", label_key(F.col("labels")))
    kept = keyed.select("__k").distinct().orderBy(F.col("__k").desc() if last else F.col("__k").asc()).limit(int(n))
    return keyed.join(F.broadcast(kept), "__k", "left_semi").select("labels", "step", "value")  # n rows


def _matched(op: str) -> Callable:
    return lambda p, grid, x, y, *tags: vectors.set_operator(x, y, op, list(tags) or None)


def _divide(p, grid, x, y, *tags):
    return vectors.binary(x, y, "/", list(tags), group="left")


def _share(p, grid, x, *rest):
    total = rest[0] if rest and isinstance(rest[0], DataFrame) else x
    return vectors.with_scalar(vectors.binary(x, vectors.aggregate(total, "sum"), "/", [], group="left"), F.lit(100.0), "*", False)


def _alias(p, grid, x, name):
    return x.withColumn("labels", F.map_concat(vectors.drop_labels(F.col("labels"), [NAME]), F.create_map(F.lit(NAME), F.lit(name))))


def _alias_by(p, grid, x, *tags):
    name = F.concat_ws(" ", *(F.try_element_at("labels", F.lit(t)) for t in tags or ("bucket",)))
    return x.withColumn("labels", F.map_concat(vectors.drop_labels(F.col("labels"), [NAME]), F.create_map(F.lit(NAME), name)))


def _fallback(p, grid, x, y):
    some = x.limit(1).groupBy().agg(F.count(F.lit(1)).alias("__n"))
    other = (y if isinstance(y, DataFrame) else vectors.constant(grid, p.spark, F.lit(float(y)))).crossJoin(F.broadcast(some)).where("__n = 0")  # one row
    return x.unionByName(other.select("labels", "step", "value"))


def _by_tag(keep: bool) -> Callable:
    def run(p, grid, x, tag, pattern):
        test = F.coalesce(F.try_element_at("labels", F.lit(tag)), F.lit("")).rlike(f"^(?:{glob_to_regex(pattern, chr(92) + 'n') if re.search(r'[*?{]', pattern) and '.*' not in pattern else pattern})$")
        return x.where(test if keep else ~test)

    return run


def _bucket_quantile(p, grid, x, id_tag, range_tag, q):
    """Buckets whose range tag ends with the upper bound, e.g. 10-20 or 20-infinity."""
    bound = F.regexp_extract(F.try_element_at("labels", F.lit(range_tag)), r"([^-]+)$", 1)
    le = F.when(F.lower(bound).isin("infinity", "inf", "+inf"), F.lit("+Inf")).otherwise(bound)
    labels = F.map_concat(vectors.drop_labels(F.col("labels"), [id_tag, range_tag, "le"]), F.create_map(F.lit("le"), le))
    w = Window.partitionBy("__g", "step").orderBy(F.expr("coalesce(try_cast(labels['le'] as double), double('infinity'))"))
    y = x.withColumn("labels", labels).withColumn("__g", label_key(vectors.drop_labels(F.col("labels"), ["le", NAME])))
    return vectors.histogram_quantile(y.withColumn("value", F.sum("value").over(w)), float(q) / 100)


def _bucket_cdf(p, grid, x, id_tag, range_tag, value):
    """Share of counts at or below ``value``, linear within the bucket."""
    low = F.expr(f"coalesce(try_cast(split(labels['{range_tag}'], '-')[0] as double), 0D)")
    high = F.expr(f"coalesce(try_cast(element_at(split(labels['{range_tag}'], '-'), -1) as double), double('infinity'))")
    inside = F.when(high <= value, 1.0).when(low >= value, 0.0).when(high == num.INF, 0.0).otherwise((F.lit(float(value)) - low) / (high - low))
    y = x.withColumn("__s", inside * F.col("value")).withColumn("labels", vectors.drop_labels(F.col("labels"), [id_tag, range_tag, NAME]))
    return y.groupBy("labels", "step").agg(num.divide(F.sum("__s"), F.sum("value")).alias("value"))


def _shift(p, grid, x, by):
    raise PipeError("timeshift stands in the pipeline that fetches")


def _show_tags(p, grid, x, show=True, *tags):
    labels = F.map_filter("labels", lambda k, _: k != NAME)
    text = F.to_json(keep_labels(labels, list(tags)) if tags else labels) if show else F.lit("")
    return x.withColumn("labels", F.map_concat(vectors.drop_labels(F.col("labels"), [NAME]), F.create_map(F.lit(NAME), text)))


def _moving_stage(p, grid, x, interval, f="avg"):
    return p._through(lambda s: g.moving(s, interval if isinstance(interval, str) else str(int(interval)), f), x, grid)


def _summarize_stage(p, grid, x, interval, f="sum", align=False):
    return p._through(lambda s: g.summarize(s, interval, f, align), x, grid)


STAGES: dict[str, Callable] = {
    **{name: _values(f) for name, f in {"abs": F.abs, "absolute": F.abs, "sqrt": F.sqrt, "squareRoot": F.sqrt, "logarithm": lambda v, base=10.0: num.log(v) / F.log(F.lit(float(base))), "scale": lambda v, k: v * float(k), "offset": lambda v, k: v + float(k),
        "removeAboveValue": lambda v, n: F.when(v <= float(n), v), "removeBelowValue": lambda v, n: F.when(v >= float(n), v), "timestamp": lambda v: F.col("step") / SECOND}.items()},
    "scaleToSeconds": lambda p, grid, x, s: x.withColumn("value", F.col("value") * (float(s) * SECOND / grid.step)),
    **{op: _compare(op) for op in ("==", "!=", ">=", ">", "<=", "<")},
    **{name: _compare(op) for name, op in (("eq", "=="), ("ne", "!="), ("ge", ">="), ("gt", ">"), ("le", "<="), ("lt", "<"))},
    "=>": _compare(">="),
    **{name: _across(f) for f in ("sum", "avg", "min", "max", "count", "multiply", "range", "diff") for name in (f, f"{'average' if f == 'avg' else f}Series")},
    "percentileOfSeries": lambda p, grid, x, n, interpolate=False, *tags: x.withColumn("labels", vectors.group_labels(list(tags), None)).groupBy("labels", "step").agg(g._percentile_of(F.collect_list("value"), float(n), bool(interpolate)).alias("value")),
    "asPercent": _share, "divideSeries": _divide, "fallbackSeries": _fallback,
    "intersect": _matched("and"), "setDiff": _matched("unless"), "union": _matched("or"),
    "alias": _alias, "aliasByTags": _alias_by, "aliasByBucket": _alias_by, "aliasByHistogramBucket": _alias_by, "showTags": _show_tags,
    "excludeByTag": _by_tag(False), "includeByTag": _by_tag(True), "includeBy": _by_tag(True),
    "head": _first_series, "tail": lambda p, grid, x, n: _first_series(p, grid, x, n, True), "sort": _sorted, "sortSeries": _sorted,
    "topk": lambda p, grid, x, n: vectors.aggregate(x, "topk", param=n), "bottomk": lambda p, grid, x, n: vectors.aggregate(x, "bottomk", param=n),
    "changed": _listed(g.changed), "derivative": _listed(g.derivative), "integral": _listed(g.integral), "perSecond": _listed(g.per_second), "isNonNull": _listed(g.is_non_null),
    "nonNegativeDerivative": _listed(g.non_negative_derivative), "keepLastValue": _listed(g.keep_last_value), "transformNull": _listed(g.transform_null), "stdev": _listed(lambda s, n, t=0.1: g.stdev(s, int(n), t)),
    "nPercentile": _listed(g.n_percentile), "removeAbovePercentile": _listed(lambda s, n: g.remove_by_percentile(s, n, True)), "removeBelowPercentile": _listed(lambda s, n: g.remove_by_percentile(s, n, False)),
    "removeEmpty": _listed(lambda s, f=0.0: g.remove_empty(s, f)), "sustain": _listed(g.sustain), "sustainedAbove": _listed(lambda s, n, i: g.sustained(s, n, i, True)), "sustainedBelow": _listed(lambda s, n, i: g.sustained(s, n, i, False)),
    "moving": _moving_stage, "summarize": _summarize_stage, "timeshift": _shift,
    "histogramPercentile": _bucket_quantile, "histogramCDF": _bucket_cdf, "promHistogramPercentile": lambda p, grid, x, q: vectors.histogram_quantile(x, float(q) / 100),
}


def rendered(x: DataFrame) -> DataFrame:
    return x.select(series_text(F.col("labels")).alias("series"), "step", "value")
