"""Queries on the tag index: a small algebra compiled into one predicate over the series dimension."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.frames import Matcher, anchored


class Query:
    def __and__(self, other: Query) -> Query:
        return Conjunction((self, other))

    def __or__(self, other: Query) -> Query:
        return Disjunction((self, other))

    def __invert__(self) -> Query:
        return Negation(self)


@dataclass(frozen=True)
class All(Query):
    pass


@dataclass(frozen=True)
class Field(Query):
    """Series that have the tag."""

    name: str


@dataclass(frozen=True)
class Term(Query):
    name: str
    value: str


@dataclass(frozen=True)
class Regexp(Query):
    """Series whose tag exists and matches fully."""

    name: str
    pattern: str


@dataclass(frozen=True)
class Negation(Query):
    inner: Query


@dataclass(frozen=True)
class Conjunction(Query):
    parts: tuple[Query, ...]


@dataclass(frozen=True)
class Disjunction(Query):
    parts: tuple[Query, ...]


def predicate(q: Query, labels: str = "labels") -> Column:
    match q:
        case All():
            return F.lit(True)
        case Field(name):
            return F.map_contains_key(labels, name)
        case Term(name, value):
            return F.coalesce(F.try_element_at(labels, F.lit(name)) == value, F.lit(False))
        case Regexp(name, pattern):
            return F.coalesce(F.try_element_at(labels, F.lit(name)).rlike(anchored(pattern)), F.lit(False))
        case Negation(inner):
            return ~predicate(inner, labels)
        case Conjunction(parts):
            return reduce(lambda a, b: a & b, [predicate(p, labels) for p in parts], F.lit(True))
        case Disjunction(parts):
            return reduce(lambda a, b: a | b, [predicate(p, labels) for p in parts], F.lit(False))
    raise TypeError(q)


def from_matchers(matchers: list[Matcher]) -> Query:
    """Matchers as an index query; no matcher means all. A pattern that matches the empty text also takes series without the tag."""
    import re

    parts: list[Query] = []
    for m in matchers:
        if m.op in ("=", "!="):
            q: Query = ~Field(m.label) | Term(m.label, "") if m.value == "" else Term(m.label, m.value)
        elif m.value in (".*", ""):
            q = All() if m.value else ~Field(m.label) | Term(m.label, "")
        elif m.value == ".+":
            q = Field(m.label) & ~Term(m.label, "")
        else:
            q = Regexp(m.label, m.value)
            if re.fullmatch(m.value, ""):
                q = q | ~Field(m.label)
        parts.append(~q if m.op in ("!=", "!~") else q)
    return Conjunction(tuple(parts)) if parts else All()


def search(series: DataFrame, q: Query) -> DataFrame:
    return series.where(predicate(q))


def facets(series: DataFrame, q: Query, values: bool = True, names: list[str] | None = None) -> DataFrame:
    """Tag names of the matching series, with their values if wanted: label[, value], n_series."""
    rows = search(series, q).select(F.explode("labels").alias("label", "value"))
    if names:
        rows = rows.where(F.col("label").isin(names))
    keys = ["label", "value"] if values else ["label"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_series"))
