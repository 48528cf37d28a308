"""The data model: labelled series over a sample store, evaluated on a regular grid of steps.

Raw frames hold ``sid, ts, value`` (ts in microseconds UTC); labels stay in a small dimension ``sid, labels`` and are joined only after samples have been
reduced to steps. Vector frames hold ``labels, step, value``; an absent sample is an absent row.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000
NAME = "__name__"


@dataclass(frozen=True)
class Grid:
    """Steps start, start+step, ... up to and including end; microseconds."""

    start: int
    end: int
    step: int

    def __post_init__(self) -> None:
        if self.step <= 0 or self.end < self.start:
            raise ValueError(f"not a grid: {self}")

    @property
    def count(self) -> int:
        return (self.end - self.start) // self.step + 1

    def shifted(self, by: int) -> Grid:
        return Grid(self.start + by, self.end + by, self.step)

    @staticmethod
    def seconds(start: float, end: float, step: float) -> Grid:
        return Grid(round(start * SECOND), round(end * SECOND), round(step * SECOND))

    def frame(self, spark) -> DataFrame:
        """All steps, as a column ``step``."""
        return spark.range(self.count).select((F.col("id") * self.step + self.start).alias("step"))


@dataclass(frozen=True)
class Matcher:
    label: str
    op: str  # = != =~ !~
    value: str


def anchored(pattern: str) -> str:
    """A fully anchored pattern; anchors already there are dropped."""
    pattern = pattern.removeprefix("^")
    if pattern.endswith("$") and not pattern.endswith("\\$"):
        pattern = pattern[:-1]
    return f"^(?:{pattern})$"


def matches(value: Column, m: Matcher) -> Column:
    """A matcher on a label's value, absent counting as empty. Trivial and literal patterns become plain comparisons that reach the scan."""
    v = F.coalesce(value, F.lit(""))
    if m.op in ("=", "!="):
        if m.value == "":
            test = value.isNull() | (value == "")
        else:
            test = value == m.value
            if m.op == "!=":
                return value.isNull() | (value != m.value)
    elif m.op in ("=~", "!~"):
        if m.value in (".*", "^.*$"):
            test = F.lit(True)
        elif m.value in (".+", "^.+$"):
            test = v != ""
        elif re.fullmatch(r"[\w|]*", m.value) and "" not in m.value.split("|"):
            test = F.coalesce(value.isin(m.value.split("|")), F.lit(False))
        else:
            test = v.rlike(anchored(m.value))
    else:
        raise ValueError(f"unknown matcher {m.op}")
    return ~test if m.op in ("!=", "!~") else test


def label_key(labels: Column) -> Column:
    """A text that is equal for equal label sets, whatever the order of entries. A null or empty label counts as absent."""
    entries = F.filter(F.array_sort(F.map_entries(labels)), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.concat_ws("\x01", F.transform(entries, lambda e: F.concat_ws("\x02", e["key"], e["value"])))


def series_id(*parts: Column) -> Column:
    """128 bits that stand for a series: two hashes of its label values in order, null (absent) counting as the empty text in its own place."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.struct(F.xxhash64(*texts).alias("a"), F.xxhash64(F.lit(1), *texts).alias("b"))


def series_text(labels: Column) -> Column:
    """``name{a="x",b="y"}`` with labels in order."""
    rest = F.filter(F.array_sort(F.map_entries(labels)), lambda e: e["key"] != NAME)
    inner = F.concat_ws(",", F.transform(rest, lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))))
    return F.concat(F.coalesce(F.try_element_at(labels, F.lit(NAME)), F.lit("")), F.lit("{"), inner, F.lit("}"))


def keep_labels(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: k.isin(names) if names else F.lit(False))


def drop_labels(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(names)) if names else labels


@dataclass
class SeriesSource:
    """A store of samples.

    ``rows`` has ``ts`` (microseconds), ``value`` and either ``labels`` (a map), or columns named in ``columns`` that hold label values, or ``sid`` with a
    separate ``series`` dimension (sid, labels). Matchers on columns become plain predicates, so they reach the Parquet scan.
    """

    rows: DataFrame
    columns: Mapping[str, str] | None = None
    series: DataFrame | None = None
    name: str | None = None
    #: labels of the result are stripped of these
    strip: tuple[str, ...] = ()
    #: matchers enforced on every selection
    restrict: tuple[Matcher, ...] = ()

    def restricted(self, matchers: list[Matcher], strip: list[str] = ()) -> SeriesSource:
        return replace(self, restrict=(*self.restrict, *matchers), strip=(*self.strip, *strip))

    def _label(self, name: str) -> Column:
        if self.columns is not None:
            if name == NAME and self.name is not None:
                return F.lit(self.name)
            return F.col(f"`{self.columns[name]}`").cast("string") if name in self.columns else F.lit(None).cast("string")
        return F.try_element_at("labels", F.lit(name))

    def _labels(self) -> Column:
        if self.columns is None:
            return drop_labels(F.col("labels"), list(self.strip))
        parts = [F.struct(F.lit(k).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for k, c in self.columns.items() if k not in self.strip]
        if self.name is not None and NAME not in self.strip:
            parts.append(F.struct(F.lit(NAME).alias("key"), F.lit(self.name).alias("value")))
        return F.map_from_entries(F.filter(F.array(*parts), lambda e: e["value"].isNotNull() & (e["value"] != "")))

    def select(self, matchers: list[Matcher], low: int | None = None, high: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Raw samples (sid, ts, value) of the matching series within [low, high], and their dimension (sid, labels). NaN and null samples are absent."""
        wanted = [matches(self._label(m.label), m) for m in (*self.restrict, *matchers)]
        keep = reduce(lambda a, b: a & b, wanted, F.lit(True))
        within = F.lit(True)
        if low is not None:
            within = within & (F.col("ts") >= low)
        if high is not None:
            within = within & (F.col("ts") <= high)
        rows = self.rows.where(within)
        if self.series is not None:
            dim = self.series.where(keep).select("sid", self._labels().alias("labels"))
            raw = rows.select("sid", "ts", "value")
            if wanted:
                raw = raw.join(dim.select("sid"), "sid", "left_semi")
        else:
            rows = rows.where(keep)
            if self.columns is not None:
                sid = series_id(*(F.col(f"`{c}`") for c in self.columns.values()))
            else:
                sid = series_id(label_key(self._labels()))
            raw = rows.select(sid.alias("sid"), "ts", "value")
            grouping = rows.select(sid.alias("sid"), *({f"`{c}`" for c in self.columns.values()} if self.columns is not None else ["labels"]))
            dim = grouping.dropDuplicates(["sid"]).select("sid", self._labels().alias("labels"))
        raw = raw.where(F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")).select("sid", "ts", F.col("value").cast("double").alias("value"))
        return raw, dim

    # the label interface

    def series_list(self, matchers: list[Matcher] = (), low: int | None = None, high: int | None = None) -> DataFrame:
        """The matching label sets, with their count of samples in the period if one is given."""
        raw, dim = self.select(list(matchers), low, high)
        return dim.select("labels") if low is None and high is None else dim.join(raw.select("sid").distinct(), "sid", "left_semi").select("labels")

    def label_names(self, matchers: list[Matcher] = ()) -> DataFrame:
        return self.series_list(matchers).select(F.explode(F.map_keys("labels")).alias("label")).distinct()

    def label_values(self, label: str, matchers: list[Matcher] = ()) -> DataFrame:
        return self.series_list(matchers).select(F.try_element_at("labels", F.lit(label)).alias("value")).where("value is not null").distinct()

    def complete_tags(self, matchers: list[Matcher] = (), names: str = ".*") -> DataFrame:
        """Label names with their sorted values, as a facet list."""
        pairs = self.series_list(matchers).select(F.explode("labels").alias("label", "value")).where(F.col("label").rlike(anchored(names)))
        return pairs.groupBy("label").agg(F.array_sort(F.collect_set("value")).alias("values"))


def fan_out(stores: list[SeriesSource], matchers: list[Matcher], low: int | None = None, high: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Read several stores as one: the same series at the same time counts once, the first store in the list winning."""
    parts = [s.select(matchers, low, high) for s in stores]
    if len(parts) == 1:
        return parts[0]
    keyed = []
    for i, (raw, dim) in enumerate(parts):
        key = dim.select("sid", series_id(label_key(F.col("labels"))).alias("key"), "labels")
        keyed.append((raw.join(key.select("sid", "key"), "sid").select(F.col("key").alias("sid"), "ts", "value", F.lit(i).alias("store")), key.select(F.col("key").alias("sid"), "labels")))
    rows = reduce(DataFrame.unionByName, [r for r, _ in keyed])
    dims = reduce(DataFrame.unionByName, [d for _, d in keyed]).dropDuplicates(["sid"])
    return rows.groupBy("sid", "ts").agg(F.min_by("value", "store").alias("value")), dims
