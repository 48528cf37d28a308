"""Rules: which metrics are aggregated how, rolled up or dropped. Rules are few and live on the driver; matching them is a column expression."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.aggregator.pipeline import Pipeline, Rollup, run
from tidewheel.aggregator.types import StoragePolicy
from tidewheel.operators.frames import NAME


class RuleError(ValueError):
    pass


def filter_regex(pattern: str) -> str:
    """A filter value's pattern: ``*`` anything, ``?`` one character, ``[a-z]``, ``[!a]``, ``{a,b*}``."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i)
            if end < 0:
                raise RuleError(f"unclosed [ in {pattern!r}")
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise RuleError(f"unbalanced braces in {pattern!r}")
    return "".join(out)


def parse_filter(text: str) -> dict[str, tuple[bool, str]]:
    """``tag:pattern`` pairs apart by spaces; ``!`` before the pattern negates. The same tag twice is an error."""
    out: dict[str, tuple[bool, str]] = {}
    for pair in text.split():
        tag, colon, pattern = pair.partition(":")
        if not colon or not tag or not pattern:
            raise RuleError(f"not a filter: {pair!r}")
        if tag in out:
            raise RuleError(f"{tag} occurs twice in {text!r}")
        negated = pattern.startswith("!")
        pattern = pattern.removeprefix("!")
        filter_regex(pattern)
        out[tag] = (negated, pattern)
    return out


def filter_column(text: str, any_: bool = False) -> Column:
    """Whether a metric (id, labels) passes the filter; all pairs must hold, or any. ``name`` stands for the metric's name. A missing tag passes only a negation."""
    tests = []
    for tag, (negated, pattern) in parse_filter(text).items():
        value = F.col("id") if tag in ("name", NAME) else F.try_element_at("labels", F.lit(tag))
        plain = re.fullmatch(r"[\w.\-/]+", pattern)
        test = value == pattern if plain else value.isNotNull() if pattern == "*" else value.rlike(f"^(?:{filter_regex(pattern)})$")
        test = F.coalesce(test, F.lit(False))
        tests.append(~test if negated else test)
    return reduce((lambda a, b: a | b) if any_ else (lambda a, b: a & b), tests, F.lit(not any_ or not tests))


@dataclass
class MappingRule:
    name: str
    filter: str
    policies: list[StoragePolicy] = field(default_factory=list)
    types: tuple[str, ...] = ()
    drop: str = "none"  # none, must, if-only-match
    cutover: int = 0
    tombstoned: bool = False


@dataclass
class RollupRule:
    name: str
    filter: str
    pipeline: Pipeline
    policies: list[StoragePolicy] = field(default_factory=list)
    keep_original: bool = True
    cutover: int = 0
    tombstoned: bool = False


def validate(rules: list) -> None:
    """Filters parse, names are unique per kind and cutover, policies or a drop are given, rollups have a name and known types."""
    seen = set()
    for r in rules:
        parse_filter(r.filter)
        key = (type(r), r.name, r.cutover)
        if not r.name or key in seen:
            raise RuleError(f"rule name {r.name!r} is empty or used twice")
        seen.add(key)
        if isinstance(r, MappingRule):
            if r.drop not in ("none", "must", "if-only-match"):
                raise RuleError(f"unknown drop policy {r.drop!r}")
            if (r.drop == "none") != bool(r.policies) and not r.tombstoned:
                raise RuleError(f"{r.name}: either storage policies or a drop policy")
        else:
            if not any(isinstance(op, Rollup) for op in r.pipeline.ops) or not r.policies:
                raise RuleError(f"{r.name}: a rollup operation and a storage policy are needed")
            for op in r.pipeline.ops:
                if isinstance(op, Rollup) and len(set(op.labels)) != len(op.labels):
                    raise RuleError(f"{r.name}: repeated rollup label")


@dataclass
class RuleSet:
    """Versions of rules with effective times; editing adds versions, so the past stays as it was."""

    rules: list = field(default_factory=list)
    defaults: list[StoragePolicy] = field(default_factory=lambda: [StoragePolicy.parse("1m:48h")])

    def add(self, rule) -> None:
        validate([*self.rules, rule])
        self.rules.append(rule)

    def update(self, rule, at: int) -> None:
        self.rules.append(replace(rule, cutover=at))
        validate(self.rules)

    def delete(self, name: str, at: int, kind: type = MappingRule) -> None:
        current = self._version(kind, name, at)
        if current is None or current.tombstoned:
            raise RuleError(f"no rule {name!r}")
        self.rules.append(replace(current, cutover=at, tombstoned=True))

    def revive(self, name: str, at: int, kind: type = MappingRule) -> None:
        current = self._version(kind, name, at)
        if current is None or not current.tombstoned:
            raise RuleError(f"{name!r} isn't deleted")
        self.rules.append(replace(current, cutover=at, tombstoned=False))

    def bulk(self, changes: list[tuple]) -> None:
        """(method, *arguments) each; all or none."""
        saved = list(self.rules)
        try:
            for method, *args in changes:
                getattr(self, method)(*args)
        except RuleError:
            self.rules = saved
            raise

    def _version(self, kind: type, name: str, at: int):
        found = [r for r in self.rules if isinstance(r, kind) and r.name == name and r.cutover <= at]
        return max(found, key=lambda r: (r.cutover, self.rules.index(r)), default=None)

    def active(self, at: int, kind: type) -> list:
        names = dict.fromkeys(r.name for r in self.rules if isinstance(r, kind))
        return [r for r in (self._version(kind, n, at) for n in names) if r is not None and not r.tombstoned]

    def matched(self, rows: DataFrame, at: int) -> DataFrame:
        """Adds ``policies`` (array of text), ``types`` and ``dropped`` by the mapping rules active at ``at``; without a match the defaults apply."""
        mappings = self.active(at, MappingRule)
        tests = [(r, filter_column(r.filter)) for r in mappings]
        empty = F.array().cast("array<string>")
        policies = reduce(F.array_union, [F.when(t, F.array(*(F.lit(str(p)) for p in r.policies)).cast("array<string>")).otherwise(empty) for r, t in tests if r.drop == "none"], empty)
        types = reduce(F.array_union, [F.when(t, F.array(*map(F.lit, r.types)).cast("array<string>")).otherwise(empty) for r, t in tests if r.drop == "none"], empty)
        false = F.lit(False)
        must = reduce(lambda a, b: a | b, [t for r, t in tests if r.drop == "must"], false)
        only = reduce(lambda a, b: a | b, [t for r, t in tests if r.drop == "if-only-match"], false)
        out = rows.withColumn("policies", policies).withColumn("types", types)
        none = F.size("policies") == 0
        out = out.withColumn("dropped", must | (only & none))
        return out.withColumn("policies", F.when(none, F.array(*(F.lit(str(p)) for p in self.defaults))).otherwise(F.col("policies")))

    def rollups(self, rows: DataFrame, at: int) -> DataFrame | None:
        """Outputs of all rollup rules active at ``at``, per storage policy: id, labels, kind, agg, ts, value, policy."""
        parts = []
        for r in self.active(at, RollupRule):
            chosen = rows.where(filter_column(r.filter))
            for p in r.policies:
                parts.append(run(chosen, r.pipeline, p.resolution).withColumn("policy", F.lit(str(p))))
        return reduce(DataFrame.unionByName, parts) if parts else None
