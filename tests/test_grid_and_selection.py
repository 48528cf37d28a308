"""The regular grid and exact selection against brute force."""

import math
import random

import numpy as np
import pytest

from tidewheel.operators import runs
from tidewheel.operators.regular_grid import regular_grid
from tidewheel.operators.selection import exact_quantiles, skew_safe_summary


def plain_grid(rows, hold=1.0):
    by = {}
    for sid, ts, v, ident, step, *_ in sorted((r for r in rows if r[1] is not None and r[2] is not None and not math.isnan(r[2]) and r[4]), key=lambda r: (r[0], r[1], r[3])):
        by.setdefault((sid, step), {}).setdefault(ts, v)
    out = {}
    for (sid, step), readings in by.items():
        w = step * 1_000_000
        ts = sorted(readings)
        for k in range(ts[0] // w, ts[-1] // w + 1):
            a, b = k * w, (k + 1) * w
            area = time = cover = n = 0
            for i, t in enumerate(ts):
                until = ts[i + 1] if i + 1 < len(ts) else (t // w + 1) * w
                low, high = max(t, a), min(until, b)
                n += a <= t < b
                if high > low:
                    area += readings[t] * (high - low)
                    time += high - low
                    cover += max(0, min(high, t + int(w * hold)) - low)
            out[sid, k * step] = (n, area / time, min(1.0, cover / w))
    return out


@pytest.mark.parametrize("seed,run_rows", [(1, 10**6), (2, 60), (3, 7)])
def test_grid(spark, monkeypatch, seed, run_rows):
    monkeypatch.setattr(runs, "RUN_ROWS", run_rows)
    r = random.Random(seed)
    rows, ident = [], 0
    for sid, step in ((1, 10), (2, 7), (3, 100), (4, 10)):
        t = r.randint(0, 10**8)
        for _ in range(400 if sid == 1 else 40):
            t += int(r.choice([1, 1, 1, 30]) * r.uniform(0.1, 2) * step * 1_000_000)
            for _ in range(r.choice([1, 1, 2])):
                ident += 1
                rows.append((sid, t, round(r.uniform(-5, 5), 3), ident, step, "x"))
    rows += [(1, None, 1.0, 90001, 10, ""), (1, 5, None, 90002, 10, ""), (2, 5, float("nan"), 90003, 7, ""), (5, 5, 1.0, 90004, None, ""), (6, 123_456_789, 2.5, 90005, 60, "")]
    df = spark.createDataFrame(rows, "sid bigint, ts bigint, value double, id bigint, step int, slot_start string").repartition(3)
    got = {(x["sid"], x["slot_start"]): x for x in regular_grid(df, "sid", "ts", "value", "id", "step").collect()}
    want = plain_grid(rows)
    assert got.keys() == want.keys()
    for k, (n, avg, cover) in want.items():
        assert got[k]["n_readings"] == n and got[k]["filled"] == (n == 0)
        assert got[k]["avg"] == pytest.approx(avg, abs=1e-9) and got[k]["coverage"] == pytest.approx(cover, abs=1e-9)


@pytest.mark.parametrize("parts", [1, 2, 7, 500])
def test_each_partition_holds_one_run(spark, parts):
    labels = runs._labels(parts)
    df = spark.createDataFrame([(int(x),) for x in labels], "x int").repartition(parts, "x")
    assert [len(p) for p in df.rdd.glom().collect()] == [1] * parts


def test_grid_of_nothing_and_long_gap(spark):
    schema = "sid bigint, ts bigint, value double, id bigint, step int"
    assert regular_grid(spark.createDataFrame([], schema), "sid", "ts", "value", "id", "step").count() == 0
    far = spark.createDataFrame([(1, 0, 1.0, 1, 1), (1, 200_000_000_000, 2.0, 2, 1)], schema)
    got = regular_grid(far, "sid", "ts", "value", "id", "step")
    assert got.count() == 200_001 and got.where("filled").count() == 199_999
    assert got.select("slot_start").distinct().count() == 200_001


def test_exact_quantiles(spark):
    r = random.Random(4)
    special = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, float("inf"), float("-inf"), 1.0, 1.0000000000000002, float("nan"), None]
    rows = []
    for key in ("a", "b", None, "hot", "none"):
        for _ in range(5000 if key == "hot" else 60):
            v = None if key == "none" else r.choice(special) if r.random() < 0.3 else r.gauss(0, 1) * 10 ** r.randint(-9, 9) if key != "hot" else r.choice([3.0, 3.0, round(r.random(), 2), r.random()])
            rows.append((key, v, "clash"))
    df = spark.createDataFrame(rows, "k string, v double, n_rows string").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {x["k"]: x for x in exact_quantiles(df, ["k"], "v", probs).collect()}
    assert set(got) == {"a", "b", None, "hot", "none"}
    for key, x in got.items():
        own = [v for k, v, _ in rows if k == key]
        good = sorted(v for v in own if v is not None and not math.isnan(v))
        assert (x["n_rows"], x["n_values"]) == (len(own), len(good))
        if not good:
            assert x["quantiles"] is None
            continue
        for p, q in zip(probs, x["quantiles"]):
            at = p * (len(good) - 1)
            a, b = good[math.floor(at)], good[min(math.floor(at) + 1, len(good) - 1)]
            want = a if a == b or at == math.floor(at) else a + (b - a) * (at - math.floor(at))
            assert q == pytest.approx(want, rel=1e-12) or (math.isnan(q) and math.isnan(want))


def test_exact_quantiles_several_keys_and_none(spark):
    df = spark.createDataFrame([("a", 1, float(i)) for i in range(101)] + [("a", None, 7.0)], "x string, y int, v double")
    got = {(r["x"], r["y"]): r["quantiles"] for r in exact_quantiles(df, ["x", "y"], "v", [0.5, 0.99]).collect()}
    assert got == {("a", 1): [50.0, 99.0], ("a", None): [7.0, 7.0]}
    assert exact_quantiles(df.limit(0), ["x", "y"], "v", [0.5]).count() == 0
    whole = exact_quantiles(df, [], "v", [1.0]).collect()
    assert [(r["n_rows"], r["quantiles"]) for r in whole] == [(102, [100.0])]


def test_hot_keys(spark):
    rows = [("m", "hot", 1.0)] * 60 + [("m", f"s{i}", float(i)) for i in range(38)] + [("m", None, 1.0), (None, "hot", 1.0)]
    got = skew_safe_summary(spark.createDataFrame(rows, "name string, service string, value double"), ["name", "service"], "value", [0.5], 0.03).collect()
    assert len(got) == 39 and [(r["service"], r["n_rows"]) for r in got if r["is_hot"]] == [("hot", 60)]
    assert np.isclose(sum(r["row_share"] for r in got), 0.98)
