"""Irregular readings onto a regular grid by validity intervals.

A reading holds from its time to the next reading's (a step function). Intersecting these intervals with the cells [k*step, (k+1)*step) gives each
cell's time-weighted average and, counting a reading as valid for at most ``max_hold``, the covered fraction of the cell. Cells from a source's
first to its last reading are all produced; those without a reading are marked and filled with the held value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.runs import Near, Readings, distinct, edges, ordered_runs, over_runs

#: Periods without a reading that one row stands for on its way to being spelled out.
PIECE = 1 << 14


def regular_grid(samples: DataFrame, source: str, time: str, value: str, ident: str, step: str, *, max_hold_steps: float = 1.0) -> DataFrame:
    """One row per source and period of its step, from the period of its first reading to that of its last.

    ``samples``: ``source`` bigint, ``time`` bigint (microseconds), ``value`` double, ``ident`` bigint, ``step`` int (seconds, the same in all rows of
    a source). Rows with a null source, time, value or step, a NaN, or a step below 1 are no readings. Several rows of one source and time are one
    reading with the value delivered first. Infinities are averaged as they are. An empty table gives no rows; a single reading gives one period.
    Other columns are ignored.

    Result: source, slot_start (k*step, seconds), n_readings, avg (time-weighted over the part of the period from the first reading on; the
    held value in a period without readings), coverage (fraction of the period within ``max_hold_steps`` steps after a reading, up to the next one),
    filled (true where n_readings is 0).

    Scale: two scans and one shuffle that cuts long sources over runs. A period that straddles runs comes from each as a share (at most two a run), added up
    by an aggregation. A stretch of empty periods travels as a few rows and is spelled out inside the JVM.
    """
    v = F.col(f"`{value}`").cast("double")
    clean = samples.where(F.col(f"`{source}`").isNotNull() & F.col(f"`{time}`").isNotNull() & F.col(f"`{ident}`").isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.col(f"`{step}`") >= 1))
    clean = clean.select(F.col(f"`{source}`").cast("bigint").alias("source"), F.col(f"`{time}`").cast("bigint").alias("ts"), F.col(f"`{ident}`").cast("bigint").alias("ident"), v.alias("value"), (F.col(f"`{step}`").cast("bigint") * 1_000_000).alias("step"))
    runs = ordered_runs(clean, "source", "ts", "ident")
    near = edges(runs, "source", "ts", "value", None, 2)

    def chain(c: dict[str, np.ndarray], edge: Near) -> tuple[Readings, np.ndarray, int, int]:
        """The run's own readings with one before and one after where there are such; their steps; where the own ones begin and end."""
        at = np.flatnonzero(distinct(c, "source", "ts"))
        own = Readings(c["source"][at], c["ts"][at], c["value"][at].astype(float), np.ones(len(at), bool))
        step = c["step"][at]
        left = edge.before
        right = edge.after.take(edge.after.ts > own.ts[-1]).take(slice(0, 1))
        if len(left) and left.ts[-1] == own.ts[0]:  # given out by an earlier run
            own, step = own.take(slice(1, None)), step[1:]
        left = left.take(slice(-1, None))
        r = Readings.join([left, own, right])
        if not len(own):
            return r, np.full(len(r), c["step"][0]), len(left), len(left)
        return r, np.r_[np.full(len(left), step[0]), step, np.full(len(right), step[-1])], len(left), len(left) + len(own)

    def slots(c: dict[str, np.ndarray], edge: Near) -> dict[str, np.ndarray] | None:
        """The periods with own readings: what the own readings, and the one before where it reaches into the period, add to each."""
        r, step, a, b = chain(c, edge)
        if a == b:
            return None
        slot = r.ts // step
        more = np.r_[r.source[1:] == r.source[:-1], False]
        until = np.where(more, np.r_[r.ts[1:], 0], (slot + 1) * step)
        valid = np.minimum(until, r.ts + (step * max_hold_steps).astype(np.int64))
        end = (slot + 1) * step
        inside = np.minimum(until, end) - r.ts
        ok_inside = np.maximum(np.minimum(valid, end) - r.ts, 0)
        first = np.r_[True, (r.source[1:] != r.source[:-1]) | (slot[1:] != slot[:-1])]
        own = np.zeros(len(r), bool)
        own[a:b] = True
        head = np.flatnonzero(first)
        n = np.add.reduceat(own.astype(np.int64), head)
        with np.errstate(invalid="ignore"):
            area, time_, cover = (np.add.reduceat(np.where(own, x, 0), head) for x in (r.value * inside, inside.astype(float), ok_inside.astype(float)))
        group = np.cumsum(first) - 1
        # the reading before reaches into the slot; the run with the slot's first reading adds it
        before = np.flatnonzero(more[:-1] & first[1:] & own[1:]) if len(r) > 1 else np.empty(0, np.int64)
        has, j = group[before + 1], before
        begin = slot[before + 1] * step[before + 1]
        reach = np.maximum(until[j] - np.maximum(r.ts[j], begin), 0)
        with np.errstate(invalid="ignore"):
            area[has] += np.where(reach > 0, r.value[j] * reach, 0)
        time_[has] += reach
        cover[has] += np.maximum(np.minimum(valid[j], until[j]) - begin, 0)
        # shared with another run: the slot goes on from the reading before or into the one after
        shared = np.zeros(len(head), bool)
        if a and not first[a]:
            shared[group[a]] = True
        if b < len(r) and not first[b]:
            shared[group[b]] = True
        mine = n > 0
        lead = np.maximum(head, a)  # the first own reading of a slot that began earlier
        return {
            "source": r.source[head][mine], "slot": slot[head][mine], "step": step[head][mine], "n": n[mine], "area": area[mine], "time": time_[mine], "cover": cover[mine], "shared": shared[mine],
            "ts": r.ts[lead][mine], "value": r.value[lead][mine], "all": (r, step, slot, own & more, valid),
        }

    def shares(c: dict[str, np.ndarray], edge: Near) -> pa.Table | None:
        """The run's shares in periods that other runs have shares in."""
        s = slots(c, edge)
        return None if s is None else pa.table({n: s[n][s["shared"]] for n in ("source", "slot", "step", "n", "area", "time", "cover", "ts", "value")})

    def cells(c: dict[str, np.ndarray], edge: Near) -> pa.Table | None:
        """The other periods with readings, and pieces of the stretches between an own reading and the next."""
        s = slots(c, edge)
        if s is None:
            return None
        keep = ~s["shared"]
        with np.errstate(invalid="ignore", divide="ignore"):
            avg = np.where(s["time"] > 0, s["area"] / s["time"], s["value"])[keep]
        full = {"source": s["source"][keep], "slot": s["slot"][keep], "step": s["step"][keep], "n": s["n"][keep], "avg": avg, "cover": s["cover"][keep], "count": np.ones(keep.sum(), np.int64), "valid": np.zeros(keep.sum(), np.int64)}
        r, step, slot, then, valid = s["all"]
        i = np.flatnonzero(then)
        gap = slot[i + 1] - slot[i] - 1
        i, gap = i[gap > 0], gap[gap > 0]
        pieces = -(-gap // PIECE)
        at = np.repeat(np.arange(len(i)), pieces)
        k = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        none = np.zeros(len(at), np.int64)
        empty = {"source": r.source[i][at], "slot": slot[i][at] + 1 + k * PIECE, "step": step[i][at], "n": none, "avg": r.value[i][at], "cover": none.astype(float), "count": np.minimum(PIECE, gap[at] - k * PIECE), "valid": valid[i][at]}
        return pa.table({n: np.concatenate([full[n], empty[n]]) for n in full})

    kinds = "source bigint, slot bigint, step bigint, n bigint, "
    out = over_runs(runs, near, cells, kinds + "avg double, cover double, count bigint, valid bigint")
    spelled = out.select("*", F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1)).alias("k"))
    start = (F.col("slot") + F.col("k")) * F.col("step")
    filled = F.col("n") == 0
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.least(F.col("valid"), start + F.col("step")) - start) / F.col("step")))
    whole = spelled.select("source", (start / 1_000_000).cast("bigint").alias("slot_start"), F.col("n").alias("n_readings"), "avg", F.when(filled, held).otherwise(F.least(F.col("cover") / F.col("step"), F.lit(1.0))).alias("coverage"), filled.alias("filled"))
    parts = over_runs(runs, near, shares, kinds + "area double, time double, cover double, ts bigint, value double")
    added = parts.groupBy("source", "slot", "step").agg(F.sum("n").alias("n"), F.sum("area").alias("area"), F.sum("time").alias("time"), F.sum("cover").alias("cover"), F.min(F.struct("ts", "value"))["value"].alias("value"))
    added = added.select(
        "source", (F.col("slot") * F.col("step") / 1_000_000).cast("bigint").alias("slot_start"), F.col("n").alias("n_readings"), F.when(F.col("time") > 0, F.try_divide("area", "time")).otherwise(F.col("value")).alias("avg"),
        F.least(F.col("cover") / F.col("step"), F.lit(1.0)).alias("coverage"), F.lit(False).alias("filled"),
    )
    return whole.unionByName(added).withColumnRenamed("source", source)
