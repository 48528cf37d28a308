"""Alignment, carrying forward, accumulation and statistics on their own."""

from tidewheel.operators import temporal, vectors
from tidewheel.operators.frames import Grid, SeriesSource

SCHEMA = "labels map<string,string>, ts bigint, value double"


def source(spark, rows):
    return SeriesSource(spark.createDataFrame([({"a": a}, t, v) for a, t, v in rows], SCHEMA))


def test_align_against_a_scan(spark):
    import random

    r = random.Random(3)
    rows = [(r.choice("xyz"), t, float(t)) for t in r.sample(range(1000), 120)]
    for start, step, count, back in ((0, 10, 90, 10), (95, 7, 50, 40), (-50, 33, 40, 3), (500, 100, 3, 2000)):
        grid = Grid(start, start + (count - 1) * step, step)
        raw, dim = source(spark, rows).select([])
        got = {(x["labels"]["a"], x["step"]): x["value"] for x in temporal.align(raw, dim, grid, back).collect()}
        want = {}
        for s in "xyz":
            for k in range(count):
                t = start + k * step
                near = [u for a, u, _ in rows if a == s and t - back <= u <= t]
                if near:
                    want[s, t] = float(max(near))
        assert got == want


def test_carry_forward_and_accumulate(spark):
    grid = Grid(0, 50, 10)
    raw, dim = source(spark, [("x", 8, 1.0), ("x", 29, 2.0), ("x", 30, 3.0), ("y", 50, 9.0), ("x", 31, None)]).select([])
    aligned = temporal.align(raw, dim, grid, 5)
    got = sorted((x["labels"]["a"], x["step"], x["value"]) for x in temporal.carry_forward(aligned, grid).collect())
    assert got == [("x", 10, 1.0), ("x", 20, 1.0), ("x", 30, 3.0), ("x", 40, 3.0), ("x", 50, 3.0), ("y", 50, 9.0)]
    points = {(x["labels"]["a"], x["step"]): [tuple(p) for p in x["points"]] for x in temporal.accumulate(raw, dim, grid, 10).collect()}
    assert points["x", 30] == [(29, 2.0), (30, 3.0)] and points["x", 40] == [(30, 3.0)] and ("x", 50) not in points


def test_statistics(spark):
    v = spark.createDataFrame([({"a": "b"}, 1, 2.0), ({"a": "b"}, 2, 4.0), ({"a": "b"}, 3, float("nan"))], "labels map<string,string>, step bigint, value double")
    r = vectors.statistics(v).collect()[0]
    assert (r["count"], r["sum"], r["min"], r["max"], r["mean"], r["stddev"]) == (2, 6.0, 2.0, 4.0, 3.0, 1.0)


def test_restrictions_apply_to_every_selection(spark):
    s = source(spark, [("x", 1, 1.0), ("y", 1, 1.0)])
    from tidewheel.operators.frames import Matcher

    raw, dim = s.restricted([Matcher("a", "=", "x")]).select([Matcher("a", "=~", "x|y")])
    assert raw.count() == 1 and dim.count() == 1
