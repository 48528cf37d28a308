"""Ordered runs: every source's rows in time order, cut into stretches of even size whatever the skew.

The order (source, time, id) is cut at boundaries taken from a bounded sample of keys, so a source that holds a third of all rows spreads over a third of
the *runs* and even the copies of one reading can spread. Rows are shuffled once, by the number of their run, and checkpointed together with that
partitioning: the passes of an operator group by run without another shuffle.

What a sequential operator needs from beyond a run's ends are a few readings, its *edges*. They go from run to run by a shuffle of their own, one row per
run and side, and meet the run's rows in a co-group; nothing about rows or runs goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.session import checkpoint, ship

#: Rows of a run, so that a run fits a task's memory some ten times over; more only where the runs would exceed ``MOST_RUNS``.
RUN_ROWS = 300_000
MOST_RUNS = 200_000
#: Keys that the sample has per run (fewer if it would have more than ``MOST_KEYS``), and keys that the driver sees at most.
KEYS_PER_RUN = 128
MOST_KEYS = 1_000_000
#: names of the columns with the run's number and with the label that stands for it where rows are partitioned
NUMBER, RUN = "__number", "__run"


@dataclass
class Readings:
    """Readings (one per source and time) as parallel arrays in order."""

    source: np.ndarray
    ts: np.ndarray
    value: np.ndarray
    ok: np.ndarray

    def __len__(self) -> int:
        return len(self.ts)

    def take(self, i) -> Readings:
        return Readings(self.source[i], self.ts[i], self.value[i], self.ok[i])

    @staticmethod
    def join(parts: list[Readings]) -> Readings:
        return Readings(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("source", "ts", "value", "ok")))

    @staticmethod
    def empty() -> Readings:
        return Readings(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))


def _boundaries(df: DataFrame, order: list[str]) -> list[np.ndarray]:
    """Keys at which the order is cut. Every task samples every so many of its rows; at most ``MOST_KEYS`` of them are looked at, whatever the size."""
    stride = max(1, RUN_ROWS // KEYS_PER_RUN)
    sample = checkpoint(df.select(*order, F.monotonically_increasing_id().alias("__at")).where(F.col("__at") % stride == 0).drop("__at"))
    size = sample.count()
    thin = -(-size // MOST_KEYS)
    if thin > 1:
        sample = sample.select("*", F.monotonically_increasing_id().alias("__at")).where(F.col("__at") % thin == 0).drop("__at")
    keys = sample.toArrow()
    arrays = [keys.column(n).to_numpy() for n in order]
    at = np.lexsort(arrays[::-1])
    every = max(1, RUN_ROWS // (stride * max(thin, 1)), -(-len(at) // MOST_RUNS))
    cut = [a[at[every::every]] for a in arrays]
    if not len(cut[0]):
        return cut
    fresh = np.r_[True, np.any([c[1:] != c[:-1] for c in cut], axis=0)]
    fresh[0] = any(c[0] != a[at[0]] for c, a in zip(cut, arrays))  # no run without rows
    return [c[fresh] for c in cut]


def _places(cut: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """How many of the (ordered) boundaries are at or before each key: binary search, all keys at once."""
    low, high = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), len(cut[0]), np.int64)
    while (open_ := low < high).any():
        mid = np.minimum((low + high) // 2, len(cut[0]) - 1)
        before, tied = np.zeros(len(low), bool), np.ones(len(low), bool)
        for c, k in zip(cut, keys):
            before |= tied & (c[mid] < k)
            tied &= c[mid] == k
        right = before | tied
        low, high = np.where(open_ & right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low


def _spark_hash(x: np.ndarray) -> np.ndarray:
    """What Spark's hash partitioning makes of ints (32-bit Murmur3, seed 42)."""

    def turn(a: np.ndarray, by: int) -> np.ndarray:
        return a << np.uint32(by) | a >> np.uint32(32 - by)

    h = turn(np.uint32(42) ^ turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).astype(np.int32)


def _labels(parts: int) -> np.ndarray:
    """Ints of which the k-th falls into the k-th of ``parts`` hash partitions, so that each partition holds one run. A miss would only cost evenness."""
    labels, at = np.full(parts, -1, np.int32), 0
    while (labels < 0).any():
        x = np.arange(at, at + 4 * parts + 16)
        part, first = np.unique(_spark_hash(x).astype(np.int64) % parts, return_index=True)
        labels[part] = np.where(labels[part] < 0, x[first], labels[part])
        at += len(x)
    return labels


def ordered_runs(df: DataFrame, source: str, time: str, ident: str) -> DataFrame:
    """``df`` with the number and label of its run, partitioned by it and ordered by (run, source, time, ident) within partitions, checkpointed.

    Two scans: one for a sample of keys, one for the shuffle. A run has about ``RUN_ROWS`` rows. Sent to the driver: at most ``MOST_KEYS`` keys of 24 bytes.
    """
    order = [source, time, ident]
    ship(df.sparkSession)
    cut = _boundaries(df, order)
    if len(cut[0]):
        shared = df.sparkSession.sparkContext.broadcast((cut, _labels(len(cut[0]) + 1)))
        at = [df.columns.index(n) for n in order]

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cut, labels = shared.value
            for b in batches:
                run = _places(cut, [b.column(i).to_numpy() for i in at])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(run.astype(np.int32)), pa.array(labels[run])], [*b.schema.names, NUMBER, RUN])

        numbered = df.mapInArrow(number, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", {NUMBER} int, {RUN} int")
    else:
        numbered = df.withColumn(NUMBER, F.lit(0)).withColumn(RUN, F.lit(0))
    return checkpoint(numbered.repartition(len(cut[0]) + 1, RUN).sortWithinPartitions(RUN, *order), keep_partitioning=True)


def distinct(columns: dict[str, np.ndarray], source: str, time: str) -> np.ndarray:
    """True where a row is the first of its source and time within the run."""
    s, t = columns[source], columns[time]
    return np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])]


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    return {n: t.column(n).to_numpy() for n in t.column_names}


_EDGE = pa.schema([("run", pa.int32()), ("label", pa.int32()), ("side", pa.int32()), ("source", pa.int64()), ("whole", pa.bool_()), ("ts", pa.list_(pa.int64())), ("value", pa.list_(pa.float64())), ("ok", pa.list_(pa.bool_()))])
_EDGE_DDL = "run int, label int, side int, source bigint, whole boolean, ts array<bigint>, value array<double>, ok array<boolean>"
#: sides: the last readings of a run go to the one after it, the first readings to the one before it
TAIL, HEAD = 1, -1


def _outermost(side: int, ok: np.ndarray, halo: int) -> np.ndarray:
    """The ``halo`` outermost readings and the ``halo`` outermost usable ones."""
    at, usable = np.arange(len(ok)), np.flatnonzero(ok)
    return np.union1d(at[-halo:], usable[-halo:]) if side == TAIL else np.union1d(at[:halo], usable[:halo])


def edges(runs: DataFrame, source: str, time: str, value: str, ok: str | None, halo: int) -> DataFrame:
    """What each run must know of its neighbours: label of the run, side, source, ts, value, ok; checkpointed.

    Side 1: up to ``halo`` usable readings (where ``ok`` is true) of the run's first source from before the run, and as many of any kind; side -1: those of
    its last source from after the run. Each time counts once, as first delivered. A side without such readings has no row.

    Where a run has too few readings of a source that goes on beyond it, the edge is completed from the runs further on by doubling: in round k from the run
    2**k away. Real runs need no such round.
    """

    def ends(t: pa.Table) -> pa.Table:
        c = _columns(t)
        at = np.flatnonzero(distinct(c, source, time))
        own = Readings(c[source][at], c[time][at], c[value][at].astype(float), c[ok][at].astype(bool) if ok else np.ones(len(at), bool))
        rows: dict[str, list] = {n: [] for n in _EDGE.names}
        for side, who in ((TAIL, own.source[-1]), (HEAD, own.source[0])):
            mine = own.take(own.source == who)
            few = len(mine) == len(own) and int(mine.ok.sum()) <= halo
            mine = mine.take(_outermost(side, mine.ok, halo))
            for n, x in zip(_EDGE.names, (int(c[NUMBER][0]), int(c[RUN][0]), side, int(who), few, mine.ts, mine.value, mine.ok)):
                rows[n].append(x)
        return pa.table({n: pa.array(x, _EDGE.field(n).type) for n, x in rows.items()})

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                side, more = r["side"], r["o_source"] is not None and r["o_source"] == r["source"]
                near, far = ({n: np.array(r[p + n], k) for n, k in (("ts", np.int64), ("value", float), ("ok", bool))} if more or not p else None for p in ("", "o_"))
                if more:
                    first, then = (far, near) if side == TAIL else (near, far)
                    later = then["ts"] > first["ts"][-1] if len(first["ts"]) else np.ones(len(then["ts"]), bool)
                    near = {n: np.concatenate([first[n], then[n][later]]) for n in near}
                usable = int(near["ok"].sum())
                at = _outermost(side, near["ok"], halo)
                rows.append((r["run"], r["label"], side, r["source"], bool(more and r["o_whole"] and usable <= halo), *(near[n][at] for n in ("ts", "value", "ok"))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), _EDGE)], _EDGE.names)

    found = checkpoint(runs.groupBy(RUN).applyInArrow(ends, _EDGE_DDL))
    far = 1
    while found.where("whole").limit(1).count():
        other = found.select((F.col("run") + F.col("side") * far).alias("run"), "side", *(F.col(n).alias(f"o_{n}") for n in ("source", "whole", "ts", "value", "ok")))
        found = checkpoint(found.where("not whole").unionByName(found.where("whole").join(other, ["run", "side"], "left").mapInArrow(extend, _EDGE_DDL)))
        far *= 2
    sent = found.select((F.col("run") + F.col("side")).alias("run"), "side", "source", "ts", "value", "ok")
    whose = found.select("run", "label", (-F.col("side")).alias("side"), "source")  # a run's first source looks at the tail before it, its last at the head after it
    return checkpoint(sent.join(whose, ["run", "side", "source"]))


@dataclass
class Near:
    """The edges of one run: readings before and after it, and the values of further columns of their rows by source."""

    before: Readings
    after: Readings
    known: dict[int, dict]

    @staticmethod
    def of(t: pa.Table) -> Near:
        sides = {TAIL: Readings.empty(), HEAD: Readings.empty()}
        known = {}
        for r in t.to_pylist():
            sides[r["side"]] = Readings(np.full(len(r["ts"]), r["source"], np.int64), np.array(r["ts"], np.int64), np.array(r["value"], float), np.array(r["ok"], bool))
            known[r["source"]] = {n: r[n] for n in t.column_names if n != RUN and n not in _EDGE.names}
        return Near(sides[TAIL], sides[HEAD], known)


def over_runs(runs: DataFrame, near: DataFrame, work: Callable[[dict[str, np.ndarray], Near], pa.Table | None], ddl: str) -> DataFrame:
    """Apply ``work(columns of a run, its edges)`` to each run. Only the edges are shuffled."""

    def each(rows: pa.Table, edge: pa.Table) -> pa.Table:
        out = work(_columns(rows), Near.of(edge)) if rows.num_rows else None
        return out if out is not None else blank

    blank = _blank(ddl)
    return runs.groupBy(RUN).cogroup(near.withColumnRenamed("label", RUN).groupBy(RUN)).applyInArrow(each, ddl)


def _blank(ddl: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.strip().rsplit(" ", 1) for f in ddl.split(",")]
    return pa.schema([(n.strip("`"), kinds[k]) for n, k in fields]).empty_table()
