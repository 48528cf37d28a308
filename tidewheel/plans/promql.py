"""Planning PromQL trees into one lazy DataFrame over a grid of steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import num
from tidewheel.operators import temporal, vectors
from tidewheel.operators.frames import Grid, SECOND, SeriesSource, label_key, series_id, series_text
from tidewheel.plans import promql_parser as p

LOOKBACK = 300 * SECOND
#: Step of a subquery that names none.
SUBQUERY_STEP = 60 * SECOND


class PlanError(ValueError):
    pass


@dataclass
class Scalar:
    """An expression over the column ``step``; ``number`` is set when it is constant."""

    column: Column
    number: float | None = None


@dataclass
class Steps:
    """A scalar taken from a vector: one value per step."""

    frame: DataFrame


@dataclass
class Engine:
    """``compat``: "native" keeps the engine's own rules (offsets rounded up to the step, scalar() of a vector passed through, label_replace anywhere);
    "prom" takes the upstream language's (exact and negative offsets, scalar() as one value per step, label_replace on the whole value)."""

    source: SeriesSource
    lookback: int = LOOKBACK
    compat: str = "native"

    @property
    def spark(self) -> SparkSession:
        return self.source.rows.sparkSession

    def query_range(self, query: str, start: float, end: float, step: float) -> DataFrame:
        """labels, step (microseconds), value for every step of [start, end] in seconds."""
        return self.run(p.parse(query), Grid.seconds(start, end, step))

    def query_instant(self, query: str, at: float) -> DataFrame:
        return self.run(p.parse(query), Grid.seconds(at, at, 1))

    def run(self, tree: object, grid: Grid) -> DataFrame:
        return self._frame(self.plan(tree, grid), grid)

    def _frame(self, x: object, grid: Grid) -> DataFrame:
        if isinstance(x, DataFrame):
            return x
        if isinstance(x, Scalar):
            return vectors.constant(grid, self.spark, x.column)
        if isinstance(x, Steps):
            return x.frame.select(vectors.literal_labels({}).alias("labels"), "step", "value")
        raise PlanError("a string is no result")

    def plan(self, e: object, grid: Grid) -> object:
        match e:
            case p.Number(v):
                return Scalar(F.lit(float(v)), float(v))
            case p.Text(v):
                return v
            case p.Selector(matchers, width, offset):
                if width is not None:
                    raise PlanError("a range needs a function")
                at = grid.shifted(-self._offset(offset, grid))
                raw, dim = self.source.select(matchers, at.start - self.lookback, at.end)
                return self._back(temporal.align(raw, dim, at, self.lookback), at, grid)
            case p.Unary("-", inner):
                x = self.plan(inner, grid)
                return Scalar(-x.column, None if x.number is None else -x.number) if isinstance(x, Scalar) else vectors.map_values(self._frame(x, grid), -F.col("value"))
            case p.Aggregation(op, inner, param, by, without):
                value = None if param is None else self._constant(param, grid)
                return vectors.aggregate(self._vector(inner, grid), op, by, without, value)
            case p.Binary():
                return self._binary(e, grid)
            case p.Call(name, args):
                return self._call(name, args, grid)
        raise PlanError(f"not an expression: {e}")

    def _offset(self, offset: int, grid: Grid) -> int:
        if self.compat == "prom":
            return offset
        if offset < 0:
            raise PlanError("offset must not be negative")
        return -(-offset // grid.step) * grid.step if grid.count > 1 else offset

    @staticmethod
    def _back(frame: DataFrame, at: Grid, grid: Grid) -> DataFrame:
        return frame if at.start == grid.start else frame.withColumn("step", F.col("step") + (grid.start - at.start))

    def _constant(self, e: object, grid: Grid) -> float | str:
        x = self.plan(e, grid)
        if isinstance(x, str):
            return x
        if isinstance(x, Scalar) and x.number is not None:
            return x.number
        raise PlanError("a constant is needed here")

    def _vector(self, e: object, grid: Grid) -> DataFrame:
        x = self.plan(e, grid)
        if not isinstance(x, DataFrame):
            raise PlanError("a vector is needed here")
        return x

    def _binary(self, e: p.Binary, grid: Grid) -> object:
        a, b = self.plan(e.left, grid), self.plan(e.right, grid)
        if isinstance(a, str) or isinstance(b, str):
            raise PlanError("a string is no operand")
        if e.op in ("and", "or", "unless"):
            if not (isinstance(a, DataFrame) and isinstance(b, DataFrame)):
                raise PlanError("set operators need vectors")
            return vectors.set_operator(a, b, e.op, e.on, e.ignoring)
        if isinstance(a, DataFrame) and isinstance(b, DataFrame):
            return vectors.binary(a, b, e.op, e.on, e.ignoring, e.group, e.include, e.bool_)
        if not isinstance(a, DataFrame) and not isinstance(b, DataFrame):
            if e.op in num.COMPARISON and not e.bool_:
                raise PlanError("comparisons between scalars need bool")
            if isinstance(a, Scalar) and isinstance(b, Scalar):
                f = num.ARITHMETIC.get(e.op) or (lambda x, y: num.COMPARISON[e.op](x, y).cast("double"))
                folded = None
                if a.number is not None and b.number is not None:
                    folded = _fold(e.op, a.number, b.number)
                return Scalar(F.lit(folded) if folded is not None else f(a.column, b.column), folded)
            a, b = self._frame(a, grid), self._frame(b, grid)
            return Steps(vectors.binary(a, b, e.op, [], None, bool_=e.bool_).select("step", "value"))
        vector, other, left = (b, a, True) if isinstance(b, DataFrame) else (a, b, False)
        if isinstance(other, Scalar):
            return vectors.with_scalar(vector, other.column, e.op, left, e.bool_)
        steps = F.broadcast(other.frame.withColumnRenamed("value", "__scalar"))  # one row per step
        return vectors.with_scalar(vector.join(steps, "step"), F.col("__scalar"), e.op, left, e.bool_)

    def _matrix(self, e: object, grid: Grid) -> tuple[DataFrame, DataFrame, Grid, int]:
        """Samples of a range argument, with the grid at which its windows end."""
        match e:
            case p.Selector(matchers, width, offset) if width is not None:
                at = grid.shifted(-self._offset(offset, grid))
                return *self.source.select(matchers, at.start - width, at.end), at, width
            case p.Subquery(inner, width, step, offset):
                at = grid.shifted(-offset)
                step = step or SUBQUERY_STEP
                first = -((width - at.start) // step) * step
                fine = Grid(first, max(first, at.end // step * step), step)
                points = self._frame(self.plan(inner, fine), fine)
                keyed = points.withColumn("sid", series_id(label_key(F.col("labels"))))
                raw = keyed.select("sid", F.col("step").alias("ts"), "value").where("not isnan(value)")
                return raw, keyed.select("sid", "labels").dropDuplicates(["sid"]), at, width
        raise PlanError("a range is needed here")

    def _call(self, name: str, args: list, grid: Grid) -> object:
        if name in temporal.RANGE_FUNCTIONS or name in ("absent_over_time", "double_exponential_smoothing"):
            name = {"double_exponential_smoothing": "holt_winters"}.get(name, name)
            at_arg = 1 if name == "quantile_over_time" else 0
            if len(args) != {"quantile_over_time": 2, "predict_linear": 2, "holt_winters": 3}.get(name, 1):
                raise PlanError(f"wrong number of arguments for {name}")
            raw, dim, at, width = self._matrix(args[at_arg], grid)
            rest = [self._constant(a, grid) for i, a in enumerate(args) if i != at_arg]
            if name == "absent_over_time":
                found = temporal.over_time(raw, dim, at, width, "present_over_time")
                return vectors.absent(self._back(found, at, grid), grid, args[0].matchers if isinstance(args[0], p.Selector) else ())
            out = self._back(temporal.over_time(raw, dim, at, width, name, *rest), at, grid)
            return out if name == "last_over_time" else vectors.map_values(out, F.col("value"))
        simple: dict[str, Callable[[], object]] = {
            "time": lambda: Scalar(F.col("step") / SECOND),
            "pi": lambda: Scalar(F.lit(3.141592653589793), 3.141592653589793),
            "vector": lambda: self._frame(self.plan(args[0], grid), grid),
            "scalar": lambda: self._scalar(args[0], grid),
            "absent": lambda: vectors.absent(self._vector(args[0], grid), grid, args[0].matchers if isinstance(args[0], p.Selector) else ()),
            "round": lambda: vectors.map_values(self._vector(args[0], grid), num.round_to(F.col("value"), self._constant(args[1], grid) if len(args) > 1 else 1.0)),
            "clamp_min": lambda: vectors.map_values(self._vector(args[0], grid), num.clamp_min(F.col("value"), F.lit(self._constant(args[1], grid)))),
            "clamp_max": lambda: vectors.map_values(self._vector(args[0], grid), num.clamp_max(F.col("value"), F.lit(self._constant(args[1], grid)))),
            "clamp": lambda: self._clamp(args, grid),
            "timestamp": lambda: self._timestamp(args[0], grid),
            "sort": lambda: self._sort(args[0], grid, False),
            "sort_desc": lambda: self._sort(args[0], grid, True),
            "histogram_quantile": lambda: vectors.histogram_quantile(self._vector(args[1], grid), self._constant(args[0], grid)),
            "label_join": lambda: vectors.label_join(self._vector(args[0], grid), *(self._constant(a, grid) for a in args[1:3]), [self._constant(a, grid) for a in args[3:]]),
            "label_replace": lambda: vectors.label_replace(self._vector(args[0], grid), *(self._constant(a, grid) for a in args[1:]), whole=self.compat == "prom"),
        }
        try:
            if name in simple:
                return simple[name]()
            if name in num.DATE:
                v = self._vector(args[0], grid) if args else vectors.constant(grid, self.spark, F.col("step") / SECOND)
                return vectors.map_values(v, num.DATE[name](F.col("value")))
            if name in num.MATH:
                return vectors.map_values(self._vector(args[0], grid), num.MATH[name](F.col("value")))
        except IndexError:
            raise PlanError(f"too few arguments for {name}") from None
        raise PlanError(f"unknown function {name}")

    def _scalar(self, e: object, grid: Grid) -> object:
        x = self.plan(e, grid)
        if not isinstance(x, DataFrame) or self.compat == "native":
            return x
        one = x.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v")).where("n = 1")
        return Steps(grid.frame(self.spark).join(one, "step", "left").select("step", F.coalesce("v", F.lit(float("nan"))).alias("value")))

    def _clamp(self, args: list, grid: Grid) -> DataFrame:
        low, high = self._constant(args[1], grid), self._constant(args[2], grid)
        v = self._vector(args[0], grid)
        return vectors.map_values(v if low <= high else v.limit(0), num.clamp_max(num.clamp_min(F.col("value"), F.lit(low)), F.lit(high)))

    def _timestamp(self, e: object, grid: Grid) -> DataFrame:
        return vectors.map_values(self._vector(e, grid), F.col("step") / SECOND)

    def _sort(self, e: object, grid: Grid, descending: bool) -> DataFrame:
        """Order matters for an instant only."""
        v = self._vector(e, grid)
        return vectors.sort_instant(v, descending) if grid.count == 1 else v


def _fold(op: str, a: float, b: float) -> float | None:
    """Constant folding of plain cases; the rest is left to Spark."""
    if op in "+-*":
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    if op == "/" and b != 0:
        return a / b
    return None


def rendered(vector: DataFrame) -> DataFrame:
    """A result with the series as text: series, step, value."""
    return vector.select(series_text(F.col("labels")).alias("series"), "step", "value")


def with_lookback(engine: Engine, lookback: int) -> Engine:
    return replace(engine, lookback=lookback)
