"""Operators on vector frames (labels, step, value): aggregation across series, vector matching, set operators, histograms, label functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewheel.functions.num import ARITHMETIC, COMPARISON, INF, NAN
from tidewheel.operators.frames import NAME, Grid, Matcher, drop_labels, keep_labels, label_key


def group_labels(by: list[str] | None, without: list[str] | None) -> Column:
    """The labels that a group keeps: those named in ``by``, or all but ``without`` and the metric name."""
    labels = F.col("labels")
    if without is not None:
        return drop_labels(labels, [*without, NAME])
    return keep_labels(labels, by or [])


def _format(v: Column) -> Column:
    """A number as label text: whole numbers without a fraction."""
    whole = ~F.isnan(v) & (F.abs(v) < 2.0**53) & (F.floor(F.when(~F.isnan(v) & (F.abs(v) < 2.0**53), v)).cast("double") == v)
    special = F.when(F.isnan(v), F.lit("NaN")).when(v == INF, F.lit("+Inf")).when(v == -INF, F.lit("-Inf"))
    return F.coalesce(special, F.when(whole, F.when(whole, v).cast("bigint").cast("string")).otherwise(v.cast("string")))


def aggregate(vector: DataFrame, op: str, by: list[str] | None = None, without: list[str] | None = None, param: float | str | None = None) -> DataFrame:
    """sum, avg, min, max, count, stddev, stdvar, quantile, group, topk, bottomk, count_values of each group and step.

    NaN values are left out; a group whose values are all NaN has no row, but counts 0. stddev and stdvar are those of a population.
    """
    grouped = vector.withColumn("labels", group_labels(by, without)) if op not in ("topk", "bottomk") else vector
    v = F.when(~F.isnan("value"), F.col("value"))
    if op in ("topk", "bottomk"):
        # ranked over the partial top k of every task, so that no task sees a whole group
        order = F.col("value").desc() if op == "topk" else F.col("value").asc()
        w = Window.partitionBy("__group", "step").orderBy(F.isnan("value"), order, "__key")
        ranked = vector.withColumn("__group", label_key(group_labels(by, without))).withColumn("__key", label_key(F.col("labels")))
        return ranked.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= int(param)).select("labels", "step", "value")
    if op == "count_values":
        return grouped.withColumn("labels", F.map_concat(drop_labels(F.col("labels"), [param]), F.create_map(F.lit(param), _format(F.col("value"))))).groupBy("labels", "step").agg(F.count(F.lit(1)).cast("double").alias("value"))
    if op == "quantile":
        q = float(param)
        value = F.percentile(v, F.lit(q)) if 0 <= q <= 1 else F.when(F.count(v) > 0, F.lit(NAN if q != q else -INF if q < 0 else INF))
    else:
        value = {
            "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_pop, "stdvar": F.var_pop, "count": F.count, "group": lambda c: F.max(F.when(c.isNotNull(), 1.0)),
        }[op](v)
    return grouped.groupBy("labels", "step").agg(value.cast("double").alias("value")).where("value is not null")


def signature(on: list[str] | None, ignoring: list[str] | None) -> Column:
    """The text by which two vectors' series match."""
    if on is not None:
        return label_key(keep_labels(F.col("labels"), on))
    return label_key(drop_labels(F.col("labels"), [*(ignoring or []), NAME]))


def _one_each(vector: DataFrame) -> DataFrame:
    """One sample per signature and step: of duplicates the last in label order."""
    return vector.groupBy("__sig", "step").agg(F.max_by(F.struct("labels", "value"), label_key(F.col("labels"))).alias("r")).select("__sig", "step", F.col("r.labels").alias("r_labels"), F.col("r.value").alias("r_value"))


def binary(left: DataFrame, right: DataFrame, op: str, on: list[str] | None = None, ignoring: list[str] | None = None, group: str | None = None, include: list[str] = (), bool_: bool = False) -> DataFrame:
    """Arithmetic or comparison of matching series, step by step.

    ``group``: "left" or "right" names the side with many series per signature, whose labels the result keeps, with ``include`` taken from the other.
    Duplicates on the other side don't fail; the last in label order counts. The metric name is dropped. Without ``on`` and ``ignoring`` all labels but
    the name match. One-to-one matching with ``on`` keeps only these labels.
    """
    if group == "right":
        swapped = binary(right, left, _Swapped(op), on, ignoring, "left", include, bool_)
        return swapped
    sig = signature(on, ignoring)
    a = left.withColumn("__sig", sig)
    b = _one_each(right.withColumn("__sig", sig))
    both = a.join(b, ["__sig", "step"])
    x, y = F.col("value"), F.col("r_value")
    if isinstance(op, _Swapped):
        x, y, op = y, x, op.op
    labels = drop_labels(F.col("labels"), [NAME])
    if group == "left":
        if include:
            labels = F.map_concat(drop_labels(labels, list(include)), keep_labels(F.col("r_labels"), list(include)))
    elif on:
        labels = keep_labels(F.col("labels"), on)
    if op in ARITHMETIC:
        return both.select(labels.alias("labels"), "step", ARITHMETIC[op](x, y).alias("value"))
    test = COMPARISON[op](x, y)
    if bool_:
        return both.select(labels.alias("labels"), "step", test.cast("double").alias("value"))
    return both.where(test).select(labels.alias("labels"), "step", F.col("value"))


class _Swapped:
    """An operator whose operands come in the other order."""

    def __init__(self, op: str) -> None:
        self.op = op


def with_scalar(vector: DataFrame, scalar: Column, op: str, scalar_left: bool, bool_: bool = False) -> DataFrame:
    """Arithmetic or comparison with a scalar (an expression over ``step``).

    A filtering comparison gives its left operand, so with the scalar on the left the result holds the scalar's value.
    """
    labels = drop_labels(F.col("labels"), [NAME]).alias("labels")
    x, y = (scalar, F.col("value")) if scalar_left else (F.col("value"), scalar)
    if op in ARITHMETIC:
        return vector.select(labels, "step", ARITHMETIC[op](x, y).cast("double").alias("value"))
    test = COMPARISON[op](x, y)
    if bool_:
        return vector.select(labels, "step", test.cast("double").alias("value"))
    return vector.where(test).select(labels, "step", x.cast("double").alias("value"))


def set_operator(left: DataFrame, right: DataFrame, op: str, on: list[str] | None = None, ignoring: list[str] | None = None) -> DataFrame:
    """and, or, unless by signature and step: semi join, union with the unmatched, anti join."""
    sig = signature(on, ignoring)
    a, b = left.withColumn("__sig", sig), right.withColumn("__sig", sig)
    keys = ["__sig", "step"]
    if op == "and":
        return a.join(b.select(*keys), keys, "left_semi").select("labels", "step", "value")
    if op == "unless":
        return a.join(b.select(*keys), keys, "left_anti").select("labels", "step", "value")
    if op == "or":
        return left.select("labels", "step", "value").unionByName(b.join(a.select(*keys), keys, "left_anti").select("labels", "step", "value"))
    raise ValueError(f"unknown set operator {op}")


def absent(vector: DataFrame, grid: Grid, matchers: list[Matcher] = ()) -> DataFrame:
    """1 at every step without any sample; labels come from the equality matchers."""
    steps = grid.frame(vector.sparkSession).join(vector.select("step").distinct(), "step", "left_anti")
    labels = {m.label: m.value for m in matchers if m.op == "=" and m.value and m.label != NAME}
    return steps.select(literal_labels(labels).alias("labels"), "step", F.lit(1.0).alias("value"))


def literal_labels(labels: dict[str, str]) -> Column:
    if not labels:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))


def constant(grid: Grid, spark, value: Column) -> DataFrame:
    """The one-series vector of a scalar."""
    return grid.frame(spark).select(literal_labels({}).alias("labels"), "step", value.cast("double").alias("value"))


def map_values(vector: DataFrame, value: Column, keep_name: bool = False) -> DataFrame:
    labels = F.col("labels") if keep_name else drop_labels(F.col("labels"), [NAME])
    return vector.select(labels.alias("labels"), "step", value.cast("double").alias("value"))


def histogram_quantile(vector: DataFrame, q: float, bound: str = "le") -> DataFrame:
    """The q-quantile of cumulative bucket counts, linear within the bucket.

    A histogram needs at least two buckets, the last with an infinite bound; counts are made non-decreasing first. q < 0 gives -Inf, q > 1 +Inf.
    """
    labels = drop_labels(F.col("labels"), [bound, NAME])
    le = F.try_element_at("labels", F.lit(bound))
    number = F.when(F.lower(le).isin("+inf", "inf"), F.lit(INF)).otherwise(F.expr(f"try_cast(labels['{bound}'] as double)"))
    buckets = vector.select(labels.alias("labels"), "step", F.struct(number.alias("le"), F.col("value").alias("c")).alias("b")).where("b.le is not null and not isnan(b.c)")
    grouped = buckets.groupBy("labels", "step").agg(F.sort_array(F.collect_list("b")).alias("b")).where(F.expr("size(b) > 1 and b[size(b) - 1].le = double('infinity')"))
    if not 0 <= q <= 1:
        return grouped.select("labels", "step", F.lit(NAN if q != q else -INF if q < 0 else INF).alias("value"))
    grouped = grouped.withColumn("b", F.expr("transform(b, (x, i) -> named_struct('le', x.le, 'c', array_max(transform(slice(b, 1, i + 1), y -> y.c))))"))
    grouped = grouped.withColumn("n", F.size("b")).withColumn("rank", F.lit(q) * F.expr("b[n - 1].c"))
    grouped = grouped.withColumn("i", F.expr("coalesce(nullif(array_position(transform(slice(b, 1, n - 1), x -> x.c >= rank), true), 0), n) - 1").cast("int"))
    start, below = F.expr("if(i > 0, b[greatest(i - 1, 0)].le, 0D)"), F.expr("if(i > 0, b[greatest(i - 1, 0)].c, 0D)")
    end, count = F.expr("b[i].le"), F.expr("b[i].c")
    inside = start + (end - start) * F.when(count - below != 0, (F.col("rank") - below) / F.when(count - below != 0, count - below)).otherwise(F.lit(NAN))
    value = F.when(F.expr("i = n - 1"), F.expr("b[n - 2].le")).when(F.expr("i = 0 and b[0].le <= 0"), F.expr("b[0].le")).otherwise(inside)
    return grouped.select("labels", "step", value.alias("value"))


def label_join(vector: DataFrame, target: str, separator: str, sources: list[str]) -> DataFrame:
    """``target`` becomes the values of ``sources`` joined; absent ones are left out. A single source changes nothing; neither do series without any."""
    if len(sources) < 2:
        return vector
    values = [F.try_element_at("labels", F.lit(s)) for s in sources]
    some = F.coalesce(*values).isNotNull()
    joined = F.map_concat(drop_labels(F.col("labels"), [target]), F.create_map(F.lit(target), F.concat_ws(separator, *values)))
    return vector.withColumn("labels", F.when(some, joined).otherwise(F.col("labels")))


def java_template(template: str) -> str:
    """``$1``, ``${1}`` and ``${name}`` as the JVM's regular expressions write them."""
    return re.sub(r"\$(\d+)", r"$\1", re.sub(r"\$\{(\d+)\}", r"$\1", template.replace("\\", "\\\\")))


def label_replace(vector: DataFrame, target: str, template: str, source: str, pattern: str, *, whole: bool = False) -> DataFrame:
    """``target`` becomes ``template`` filled from the first match of ``pattern`` in ``source``; series without a match stay as they are.

    The pattern matches anywhere unless ``whole``. An empty result removes the label.
    """
    value = F.try_element_at("labels", F.lit(source))
    value = F.coalesce(value, F.lit("")) if whole else value
    inner = f"^(?:{pattern})$" if whole else pattern
    # everything but the first match is cut away, then the match is replaced by the filled template
    match = F.regexp_substr(value, F.lit(inner))
    filled = F.regexp_replace(match, f"^(?:{inner.removeprefix('^').removesuffix('$') if not whole else inner})$", java_template(template))
    replaced = F.map_filter(F.map_concat(drop_labels(F.col("labels"), [target]), F.create_map(F.lit(target), filled)), lambda _, v: v != "")
    return vector.withColumn("labels", F.when(match.isNotNull(), replaced).otherwise(F.col("labels")))


def sort_instant(vector: DataFrame, descending: bool = False) -> DataFrame:
    """Order of an instant vector; NaN last."""
    v = F.col("value")
    return vector.orderBy(F.isnan(v), v.desc() if descending else v.asc(), label_key(F.col("labels")))


def statistics(vector: DataFrame) -> DataFrame:
    """Count, sum, extremes, mean and population deviation of each series over its steps."""
    v = F.when(~F.isnan("value"), F.col("value"))
    key = vector.withColumn("__k", label_key(F.col("labels")))
    out = key.groupBy("__k").agg(F.first("labels").alias("labels"), F.count(v).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"))
    return out.drop("__k")


def restrict_tags(vector: DataFrame, strip: list[str]) -> DataFrame:
    return vector.withColumn("labels", drop_labels(F.col("labels"), strip))


def _without(name: str, value: str):
    return lambda k, v: ~((k == name) & (v == value))


def _replacing(name: str, old: str, new: str):
    return lambda k, v: F.when((k == name) & (v == old), F.lit(new)).otherwise(v)


def map_tags(rows: DataFrame, *, write: dict[str, str] = {}, drop: list[str] = (), drop_with_value: dict[str, str] = {}, replace: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Tag changes on write: set a tag, drop a tag, drop it where it has a value, replace a value by another."""
    labels = F.col("labels")
    if write:
        labels = F.map_concat(drop_labels(labels, list(write)), literal_labels(write))
    labels = drop_labels(labels, list(drop))
    for k, v in drop_with_value.items():
        labels = F.map_filter(labels, _without(k, v))
    for k, old, new in replace:
        labels = F.transform_values(labels, _replacing(k, old, new))
    return rows.withColumn("labels", labels)


