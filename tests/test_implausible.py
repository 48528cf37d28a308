"""The implausible-reading operator against a plain restatement of its rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import implausible, runs
from tidewheel.operators.implausible import flag_implausible, forward_backward, impossible, prominence, run_lengths

SCHEMA = "sid bigint, ts bigint, value double, id bigint, bad boolean, source string, ok string"


def expected(rows, spike_steps=20.0, spike_readings=3, min_run=8, steady=0.6):
    """Ids flagged by the definition, reading by reading."""
    by, ids = {}, {}
    for sid, ts, value, ident, bad, *_ in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and not math.isnan(r[2])), key=lambda r: (r[0], r[1], r[3])):
        by.setdefault(sid, {}).setdefault(ts, (value, bool(bad)))
        ids.setdefault((sid, ts), []).append(ident)
    out = set()
    for sid, readings in by.items():
        hit = {t for t, (_, bad) in readings.items() if bad}
        good = [(t, v) for t, (v, bad) in readings.items() if not bad]
        v = [x for _, x in good]
        steps = [abs(b - a) for a, b in zip(v, v[1:])]
        if steps and sum(s == 0 for s in steps) / len(steps) < steady:
            limit = spike_steps * float(np.median(steps))
            for n in range(1, spike_readings + 1):
                for i in range(1, len(v) - n):
                    a, b, g = v[i - 1], v[i + n], v[i : i + n]
                    if min(g) - max(a, b) > limit or min(a, b) - max(g) > limit:
                        hit |= {good[j][0] for j in range(i, i + n)}
            i = 0
            while i < len(v):
                j = i
                while j + 1 < len(v) and v[j + 1] == v[i]:
                    j += 1
                if j - i >= min_run - 1:
                    hit |= {good[k][0] for k in range(i, j + 1)}
                i = j + 1
        for t in hit:
            out |= set(ids[sid, t])
    return out


def made(seed, sources=6, n=300):
    r = random.Random(seed)
    rows, ident = [], 0
    for sid in range(sources):
        x, t = 100.0, 0
        steady = sid == 4
        for i in range(n * (8 if sid == 0 else 1)):
            t += r.randint(1, 100)
            x = x if steady and r.random() < 0.8 else round(x + r.gauss(0, 1), 2)
            v, bad = x, False
            if r.random() < 0.01:
                v = x + r.choice([-1, 1]) * r.uniform(10, 200)
            if r.random() < 0.01:
                v, bad = -5.0, True
            for _ in range(r.choice([1, 1, 1, 2])):
                ident += 1
                rows.append((sid, t, v + (0.001 if _ else 0), ident, bad, "x", "y"))
            if r.random() < 0.01:
                for _ in range(r.randint(5, 12)):
                    t += 7
                    ident += 1
                    rows.append((sid, t, x, ident, False, "x", "y"))
            if r.random() < 0.01:
                up = r.uniform(30, 90)
                for _ in range(r.randint(1, 4)):
                    t += 5
                    ident += 1
                    rows.append((sid, t, x + up, ident, False, "x", "y"))
    rows += [(None, 5, 1.0, ident + 1, False, "x", "y"), (1, None, 1.0, ident + 2, False, "x", "y"), (1, 6, None, ident + 3, False, "x", "y"), (1, 7, float("nan"), ident + 4, None, "x", "y"), (99, 5, 3.0, ident + 5, None, "x", "y")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,run_rows", [(1, 10**6), (2, 700), (3, 150)])
def test_matches_definition_in_any_cut(spark, monkeypatch, seed, run_rows):
    """One source holds most rows and is cut over several runs; columns with clashing names are ignored."""
    monkeypatch.setattr(runs, "RUN_ROWS", run_rows)
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = flag_implausible(df, "sid", "ts", "value", "id", "bad")
    assert got.columns == ["id", "sid", "ts", "value", "p_spike", "p_stuck", "p_range", "flag"]
    rows_out = got.collect()
    assert {r["id"] for r in rows_out} == expected(rows)
    assert len({r["id"] for r in rows_out}) == len(rows_out)
    assert all(0.5 <= r["p_spike"] + r["p_stuck"] + r["p_range"] <= 1.0001 for r in rows_out)


@pytest.mark.parametrize("how", [{"spike_steps": 10.0}, {"spike_steps": 4.0, "spike_readings": 1}, {"min_run": 4}, {"min_run": 2}, {"min_run": 40}, {"spike_readings": 5, "min_run": 6, "steady": 0.3}])
def test_parameters_move_the_flags(spark, monkeypatch, how):
    monkeypatch.setattr(runs, "RUN_ROWS", 400)
    rows = made(11, sources=4)
    ident = 10**6
    for k in range(3):  # a long frozen stretch
        rows += [(2, 10**7 + k * 10**5 + i, 50.0 + k, ident + 1000 * k + i, False, "x", "y") for i in range(38 + k)]
    got = {r["id"] for r in flag_implausible(spark.createDataFrame(rows, SCHEMA), "sid", "ts", "value", "id", "bad", **how).collect()}
    assert got == expected(rows, **how) and got != expected(rows)


def test_impossible_readings_do_not_break_a_run(spark):
    values = [float(i % 3) for i in range(40)]
    values[10:10] = [5.0] * 4 + [-1.0] + [5.0] * 3 + [-1.0, -1.0] + [5.0]
    values += [70.0, -1.0, 70.0] + [float(i % 3) for i in range(9)]
    rows = [(1, i, v, i, v < 0, "", "") for i, v in enumerate(values)]
    got = flag_implausible(spark.createDataFrame(rows, SCHEMA), "sid", "ts", "value", "id", "bad").collect()
    assert {r["id"] for r in got} == expected(rows) >= set(range(10, 21)) | {51, 52, 53}
    assert {r["id"]: r["flag"] for r in got}[14] == "impossible"


def test_fifteen_steps_and_runs_of_four(spark):
    walk = [float(i % 2) for i in range(60)]
    walk[30] = 16.0
    rows = [(1, i, v, i, False, "", "") for i, v in enumerate(walk)]
    half = [v for i in range(40) for v in ([i] * 2 if i % 2 else [i])]
    half[20:20] = [77.0] * 4
    rows += [(2, i, float(v), 1000 + i, False, "", "") for i, v in enumerate(half)]
    df = spark.createDataFrame(rows, SCHEMA)
    flagged = lambda **how: {r["id"] for r in flag_implausible(df, "sid", "ts", "value", "id", "bad", **how).collect()}
    assert flagged() == set() and flagged(spike_steps=10.0) == {30} | {i for i in expected(rows, spike_steps=10.0) if i >= 1000}
    assert {1020, 1021, 1022, 1023} <= flagged(min_run=4) == expected(rows, min_run=4)


def test_probabilities_grow_with_the_evidence(spark):
    rows = [(s, i, float(i % 2) + (up if i == 30 else 0), 100 * s + i, False, "", "") for s, up in enumerate((21.5, 30.0, 300.0), 1) for i in range(60)]
    got = {r["sid"]: r["p_spike"] for r in flag_implausible(spark.createDataFrame(rows, SCHEMA), "sid", "ts", "value", "id", "bad").collect()}
    assert 0.5 < got[1] < got[2] < got[3]
    assert flag_implausible(spark.createDataFrame(rows, SCHEMA), "sid", "ts", "value", "id", "bad", min_share=(got[1] + got[2]) / 2).count() == 2
    with pytest.raises(ValueError):
        flag_implausible(spark.createDataFrame(rows, SCHEMA), "sid", "ts", "value", "id", "bad", min_run=1)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert flag_implausible(empty, "sid", "ts", "value", "id", "bad").count() == 0
    one = spark.createDataFrame([(1, 1, 5.0, 1, False, "", ""), (2, 1, -5.0, 2, True, "", "")], SCHEMA)
    assert [r["id"] for r in flag_implausible(one, "sid", "ts", "value", "id", "bad").collect()] == [2]


def test_copies_over_several_runs(spark, monkeypatch):
    """A reading delivered more often than a run has rows counts once, with its first value, and all deliveries are flagged."""
    monkeypatch.setattr(runs, "RUN_ROWS", 40)
    rows = [(1, t * 10, 100.0 + t % 3, t, False, "", "") for t in range(60)]
    rows += [(1, 305, 9000.0 + (i > 0), 1000 + i, False, "", "") for i in range(200)]
    got = {r["id"] for r in flag_implausible(spark.createDataFrame(rows, SCHEMA), "sid", "ts", "value", "id", "bad").collect()}
    assert got == set(range(1000, 1200)) == expected(rows)


def test_forward_backward_equals_plain_recursion():
    rng, m = np.random.default_rng(0), implausible.Model.of(3, 8)
    w, fresh = rng.random((203, 6)) + 1e-3, rng.random(203) < 0.05
    fresh[0] = True
    a = np.zeros((203, 6))
    for t in range(203):
        a[t] = (m.start if fresh[t] else a[t - 1] @ m.step) * w[t]
        a[t] /= a[t].sum()
    b = np.ones((203, 6))
    for t in range(201, -1, -1):
        b[t] = np.full(6, (m.start * w[t + 1] * b[t + 1]).sum()) if fresh[t + 1] else m.step @ (w[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    p = a * b
    assert np.allclose(forward_backward(w, fresh, m), p / p.sum(axis=1, keepdims=True))


def test_features():
    v, s = np.array([1.0, 9, 9, 1, 5, 5, 0]), np.zeros(7, int)
    assert prominence(v, s).tolist() == [0, 8, 8, 4, 4, 4, 0]
    assert run_lengths(v, s).tolist() == [1, 2, 2, 1, 2, 2, 1]
    assert run_lengths(np.array([]), np.array([])).tolist() == []


def test_bounds(spark):
    rows = [(-1.0, "count", False, True), (-1.0, "celsius", False, False), (-300.0, "celsius", False, True), (1.5, "ratio", None, True), (101.0, "percent", False, True), (-5.0, "seconds", True, False), (float("inf"), "volts", True, True), (3.0, None, None, False)]
    df = spark.createDataFrame(rows, "v double, unit string, signed boolean, want boolean")
    assert df.where(impossible(F.col("v"), F.col("unit"), F.col("signed")) != F.col("want")).count() == 0
