"""Implausible readings: a hidden Markov model per source, forward-backward probabilities and hard bounds.

States are normal, spike, stuck and out-of-range. A reading's evidence is judged on its source's own scale:

* its *prominence*, how far the group of readings that holds it stands out above (below) both neighbours, in units of the source's median absolute step:
  exponential under normal, log-uniform from ``spike_steps`` on under spike;
* the length of its run of equal values, against the source's own share of repeats: geometric under normal, at least ``min_run`` under stuck;
* the hard bounds of its kind of measurement, which force out-of-range.

The model is derived from the parameters: how fast prominence and runs thin out under normal is set so that a lone group just beyond ``spike_steps``, and a
run of just ``min_run``, are ``ODDS`` to one against being normal. At the default the exponential is that of Laplace steps with the source's median. A
source in which at least ``steady`` of the steps are repeats has no spike or stuck state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.runs import Near, Readings, distinct, edges, ordered_runs, over_runs
from tidewheel.operators.selection import exact_quantiles
from tidewheel.session import checkpoint

#: Readings beyond a run's end that warm the chain up (at least two longest groups and two stuck runs).
HALO = 72
NORMAL, SPIKE, STUCK, RANGE = range(4)
#: Chance that a disturbance begins at a reading.
ENTER = 0.001
#: Odds against normal at the bounds.
ODDS = 3.0
#: Prominence up to which a spike may reach, in units of the bound.
REACH = 1e9
#: A normal reading is in a run of ``min_run`` or more with a chance of e to this at most.
RUN_CHARGE = -3.0
FLAGS = np.array(["", "spike", "stuck", "impossible"], dtype=object)


@dataclass(frozen=True)
class Model:
    """Start and step probabilities (of normal, spike, stuck, and of out-of-range in the course of each); how fast prominence thins out under normal (per
    bound) and the largest log ratio of its run lengths."""

    start: np.ndarray
    step: np.ndarray
    fall: float
    repeat: float
    min_run: int

    @staticmethod
    def of(spike_readings: int, min_run: int) -> Model:
        if spike_readings < 1 or min_run < 2:
            raise ValueError("a spike has at least one reading and a stuck run at least two")
        stay = max(0.001, (spike_readings - 1) / (spike_readings + 2))
        leave = 1 / (4 * min_run)
        first = np.array([1 - 2 * ENTER, ENTER, ENTER])
        base = np.array([first, [0.99 * (1 - stay), stay, 0.01 * (1 - stay)], [0.99 * leave, 0.01 * leave, 1 - leave]])
        # a reading out of range leaves the state it interrupts as it was
        off = ENTER * np.eye(3)
        step = np.block([[(1 - ENTER) * base, off], [(1 - ENTER) * base, off]])
        start = np.r_[(1 - ENTER) * first, ENTER * first]
        normal = base[NORMAL, NORMAL]
        lone = ENTER * base[SPIKE, NORMAL] / normal**2
        fall = 10.0
        for _ in range(50):  # fall x exp(-fall) x ODDS = density of the bound under spike x lone
            fall = np.log(ODDS * fall * np.log(REACH) / lone)
        run = ENTER * (1 - leave) ** (min_run - 1) * base[STUCK, NORMAL] / normal ** (min_run + 1)
        return Model(start, step, float(fall), float(np.log(run / ODDS) / (min_run - 1)), min_run)


def prominence(value: np.ndarray, source: np.ndarray, longest: int = 3) -> np.ndarray:
    """How far the most outstanding group of at most ``longest`` readings around each reading lies beyond both neighbours of the group; 0 if none."""
    n = len(value)
    out = np.zeros(n)
    for length in range(1, longest + 1):
        k = n - length - 1
        if k <= 0:
            break
        low, high = value[1 : k + 1].copy(), value[1 : k + 1].copy()
        for j in range(1, length):
            np.minimum(low, value[1 + j : 1 + j + k], out=low)
            np.maximum(high, value[1 + j : 1 + j + k], out=high)
        a, b = value[:k], value[length + 1 :]
        with np.errstate(over="ignore", invalid="ignore"):
            p = np.maximum(low - np.maximum(a, b), np.minimum(a, b) - high)
        p[source[:k] != source[length + 1 :]] = 0
        for j in range(length):
            np.maximum(out[1 + j : 1 + j + k], p, out=out[1 + j : 1 + j + k])
    return out


def run_lengths(value: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Length of the run of equal values of one source that holds each reading."""
    if not len(value):
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (source[1:] != source[:-1])])
    size = np.diff(np.r_[start, len(value)])
    return np.repeat(size, size)


def forward_backward(weight: np.ndarray, fresh: np.ndarray, model: Model) -> np.ndarray:
    """State probabilities of a chain given each position's emission ``weight`` (n x states); ``fresh`` marks the first reading of a source.

    The chain is cut in about sqrt(n) blocks. Products of step matrices are taken over all blocks at once, then joined along the blocks, which gives
    each block's exact incoming message; so the work is vectorised though the recursion isn't shortened.
    """
    n, s = weight.shape
    if not n:
        return weight
    length = max(8, int(np.sqrt(n)))
    blocks = -(-n // length)
    w = np.ones((blocks * length, s))
    w[:n] = weight
    f = np.zeros(blocks * length, bool)
    f[:n] = fresh
    f[0] = True
    w, f = w.reshape(blocks, length, s), f.reshape(blocks, length)

    def step(t: int) -> np.ndarray:  # blocks x from x to
        return np.where(f[:, t, None, None], model.start, model.step)

    through = np.broadcast_to(np.eye(s), (blocks, s, s))
    for t in range(length):
        through = (through @ step(t)) * w[:, t, None, :]
        through = through / np.maximum(through.max(axis=(1, 2), keepdims=True), 1e-300)
    into, out_of = np.empty((blocks, s)), np.empty((blocks, s))
    message = model.start
    for b in range(blocks):
        into[b] = message
        message = message @ through[b]
        message = message / max(message.sum(), 1e-300)
    message = np.ones(s)
    for b in range(blocks - 1, -1, -1):
        out_of[b] = message
        message = through[b] @ message
        message = message / max(message.max(), 1e-300)
    forward = np.empty_like(w)
    message = into
    for t in range(length):
        message = (message[:, None, :] @ step(t))[:, 0] * w[:, t]
        message = message / np.maximum(message.sum(axis=1, keepdims=True), 1e-300)
        forward[:, t] = message
    message = out_of
    for t in range(length - 1, -1, -1):
        forward[:, t] *= message
        message = (step(t) @ (w[:, t] * message)[:, :, None])[:, :, 0]
        message = message / np.maximum(message.max(axis=1, keepdims=True), 1e-300)
    p = forward.reshape(-1, s)[:n]
    return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)


def emissions(stand: np.ndarray, bound: np.ndarray, run: np.ndarray, repeats: np.ndarray, ok: np.ndarray, steady: float, model: Model) -> np.ndarray:
    """Emission weights (n x 4) of readings by prominence, its bound, run length, share of repeats and whether within the hard bounds."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        z = np.where(stand > 0, stand / bound, 0.0)
        beyond = stand > bound
    z = np.clip(np.nan_to_num(z, nan=0.0, posinf=REACH), 0, REACH)
    thin = np.log(model.fall) - model.fall * np.minimum(z, 50)
    ratio = np.minimum(np.log(np.clip(repeats, 1e-4, 1.0)), model.repeat)
    length = np.where(run >= model.min_run, np.minimum((run - 1) / run * ratio, RUN_CHARGE), 0.0)
    varies = repeats < steady
    spike = np.where(varies & beyond, -np.log(np.maximum(z, 1) * np.log(REACH)), -np.inf)
    log = np.stack([thin + length, spike, np.where(varies & (run >= model.min_run), thin, -np.inf), np.full(len(z), -np.inf)], axis=1)
    log[~varies, NORMAL] = 0.0
    log[~ok] = [-np.inf, -np.inf, -np.inf, 0.0]
    return np.exp(log - log.max(axis=1, keepdims=True))


def impossible(value: Column, unit: Column, signed: Column) -> Column:
    """True for a reading that its kind of measurement can't have: infinite, below its floor or above its ceiling."""
    floor = F.when(unit == "celsius", F.lit(-273.15)).when(F.coalesce(signed, F.lit(False)), F.lit(float("-inf"))).otherwise(F.lit(0.0))
    ceiling = F.when(unit == "ratio", F.lit(1.0)).when(unit == "percent", F.lit(100.0)).otherwise(F.lit(float("inf")))
    return (F.abs(value) == float("inf")) | (value < floor) | (value > ceiling)


def _pairs(r: Readings) -> tuple[np.ndarray, np.ndarray]:
    """Source and absolute step of consecutive readings of the same source."""
    same = r.source[1:] == r.source[:-1]
    with np.errstate(over="ignore"):
        return r.source[1:][same], np.abs(np.diff(r.value))[same]


def _grouped_median(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, the median of each and its share of zeros."""
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    keys, start, size = np.unique(key, return_index=True, return_counts=True)
    a, b = value[start + (size - 1) // 2], value[start + size // 2]
    zeros = np.add.reduceat((value == 0).astype(float), start) if len(start) else np.zeros(0)
    return keys, np.where(a == b, a, a + (b - a) / 2), zeros / np.maximum(size, 1)


def flag_implausible(
    samples: DataFrame, source: str, time: str, value: str, ident: str, out_of_range: str, *,
    min_share: float = 0.5, spike_steps: float = 20.0, spike_readings: int = 3, min_run: int = 8, steady: float = 0.6,
) -> DataFrame:
    """The rows of implausible readings with their state probabilities.

    ``samples``: ``source`` bigint, ``time`` bigint, ``value`` double, ``ident`` bigint (unique), ``out_of_range`` boolean (hard bounds). Rows with a
    null source, time or value or a NaN are no readings and never flagged; rows of one source and time are one reading with the value delivered first
    (least ``ident``), and all of them are flagged with it. An empty table gives no rows; a source of one reading can only be out of range. Columns
    other than those named are ignored, whatever their names.

    Result: ident, source, time, value, p_spike, p_stuck, p_range (forward-backward probabilities), flag (most probable of the three), for the readings
    whose probability of not being normal is at least ``min_share``. At the default these are the readings out of range, those in a group of at most
    ``spike_readings`` beyond both neighbours by more than ``spike_steps`` median steps, and those in a run of at least ``min_run`` equal values; steps,
    groups and runs are taken over the readings within bounds. A higher ``min_share`` wants clearer cases.

    Scale: two scans and one shuffle of (source, time, ident, value, bound); sources are cut over runs wherever needed. Within a run the recursion is
    exact; messages from other runs begin ``HALO`` readings (more for long ``min_run``) away. Median steps of sources within one run are exact there; those of sources across runs (at most
    one per boundary) come from ``exact_quantiles``. Edges and medians reach the runs by shuffles.
    """
    v = F.col(f"`{value}`").cast("double")
    clean = samples.where(F.col(f"`{source}`").isNotNull() & F.col(f"`{time}`").isNotNull() & F.col(f"`{ident}`").isNotNull() & v.isNotNull() & ~F.isnan(v))
    clean = clean.select(F.col(f"`{source}`").cast("bigint").alias("source"), F.col(f"`{time}`").cast("bigint").alias("ts"), F.col(f"`{ident}`").cast("bigint").alias("ident"), v.alias("value"), (~F.coalesce(F.col(f"`{out_of_range}`"), F.lit(False))).alias("ok"))
    model = Model.of(spike_readings, min_run)
    runs = ordered_runs(clean, "source", "ts", "ident")
    near = edges(runs, "source", "ts", "value", "ok", max(HALO, 2 * min_run, 4 * spike_readings))

    def chain(c: dict[str, np.ndarray], edge: Near) -> tuple[Readings, np.ndarray, np.ndarray]:
        """The run's readings with those just outside, which of them are the run's own, and each row's reading."""
        first = distinct(c, "source", "ts")
        at = np.flatnonzero(first)
        own = Readings(c["source"][at], c["ts"][at], c["value"][at].astype(float), c["ok"][at].astype(bool))
        left = edge.before
        if len(left) and left.ts[-1] == own.ts[0]:  # the first reading began in an earlier run, whose value counts
            own.value[0], own.ok[0] = left.value[-1], left.ok[-1]
            left = left.take(slice(None, -1))
        right = edge.after.take(edge.after.ts > own.ts[-1])
        core = np.r_[np.zeros(len(left), bool), np.ones(len(own), bool), np.zeros(len(right), bool)]
        return Readings.join([left, own, right]), core, np.cumsum(first) - 1 + len(left)

    def steps(c: dict[str, np.ndarray], edge: Near) -> pa.Table:
        """Absolute steps of the sources that span runs; each step belongs to the run of its second reading."""
        r, core, _ = chain(c, edge)
        keep = r.ok & np.isin(r.source, np.array(list(edge.known), np.int64))
        r, core = r.take(keep), core[keep]
        same = (r.source[1:] == r.source[:-1]) & core[1:]
        with np.errstate(over="ignore"):
            return pa.table({"source": r.source[1:][same], "step": np.abs(np.diff(r.value))[same]})

    if near.limit(1).count():
        sizes = checkpoint(over_runs(runs, near, steps, "source bigint, step double"))
        zero = sizes.groupBy("source").agg(F.avg((F.col("step") == 0).cast("double")).alias("repeats"))
        scale = exact_quantiles(sizes, ["source"], "step", [0.5]).select("source", F.col("quantiles")[0].alias("scale"))
        near = near.join(scale.join(zero, "source"), "source", "left").select(*near.columns, "scale", "repeats")

    def flags(c: dict[str, np.ndarray], edge: Near) -> pa.Table:
        r, _, row = chain(c, edge)
        ok = np.flatnonzero(r.ok)
        good = r.take(ok)
        keys, scale, repeats = _grouped_median(*_pairs(good))
        # a source without two readings within bounds has nothing to compare; one that goes on elsewhere has its medians from all runs
        of = np.searchsorted(keys, r.source) if len(keys) else np.zeros(len(r), np.int64)
        known = keys[np.minimum(of, len(keys) - 1)] == r.source if len(keys) else np.zeros(len(r), bool)
        scale, repeats = (np.where(known, x[np.minimum(of, len(keys) - 1)], none) if len(keys) else np.full(len(r), none) for x, none in ((scale, np.inf), (repeats, 1.0)))
        for who, x in edge.known.items():
            if x["scale"] is not None:
                mine = r.source == who
                scale[mine], repeats[mine] = x["scale"], x["repeats"]
        stand, run_length = np.zeros(len(r)), np.ones(len(r), np.int64)
        stand[ok], run_length[ok] = prominence(good.value, good.source, spike_readings), run_lengths(good.value, good.source)
        fresh = np.r_[True, r.source[1:] != r.source[:-1]]
        with np.errstate(over="ignore", invalid="ignore"):
            bound = spike_steps * scale
        p = forward_backward(emissions(stand, bound, run_length, repeats, r.ok, steady, model)[:, [NORMAL, SPIKE, STUCK, RANGE, RANGE, RANGE]], fresh, model)
        p[:, RANGE] = p[:, RANGE:].sum(axis=1)
        p = p[:, : RANGE + 1]
        state = np.where(1 - p[:, NORMAL] >= min_share, 1 + p[:, 1:].argmax(axis=1), NORMAL)
        at = np.flatnonzero((state != NORMAL)[row])
        i = row[at]
        return pa.table({
            ident: c["ident"][at], source: c["source"][at], time: c["ts"][at], value: c["value"][at], "p_spike": p[i, SPIKE], "p_stuck": p[i, STUCK],
            "p_range": p[i, RANGE], "flag": pa.array(FLAGS[state[i]], pa.string()),
        })

    return over_runs(runs, near, flags, f"`{ident}` bigint, `{source}` bigint, `{time}` bigint, `{value}` double, p_spike double, p_stuck double, p_range double, flag string")
