"""Dotted-path targets and the pipeline language over small series."""

import pytest

from tidewheel.functions.paths import glob_to_regex, parse_interval, parse_time, path_labels, path_matchers
from tidewheel.operators.frames import SECOND, SeriesSource
from tidewheel.plans import pipes
from tidewheel.plans.graphite import Function, Path, Renderer, TargetError, parse_target
from tidewheel.plans.pipes import Pipes


@pytest.fixture(scope="module")
def renderer(spark):
    data = {"a.x.cpu": [1, 2, None, 4], "a.y.cpu": [10, 20, 30, None], "a.x.mem": [5, 5, 5, 5], "b.x.cpu": [7, 3, 9, 1], "a.x.cpu.core": [1, 1, 1, 1], "a.z10.cpu": [0, 0, None, None], "a.z9.cpu": [None, None, None, -1]}
    rows = [(path_labels(p), (60 * i + 5) * SECOND, float(v)) for p, vs in data.items() for i, v in enumerate(vs) if v is not None]
    return Renderer(SeriesSource(spark.createDataFrame(rows, "labels map<string,string>, ts bigint, value double")), now=240)


def run(renderer, target, **kw):
    out = {}
    for r in renderer.render(target, 0, 240 * SECOND, 60 * SECOND, **kw).orderBy("ord", "step").collect():
        out.setdefault(r["name"], {})[r["step"] // (60 * SECOND)] = round(r["value"], 6)
    return out


def line(*values):
    return {i: float(v) for i, v in enumerate(values) if v is not None}


CASES = {
    "a.x.cpu": {"a.x.cpu": line(1, 2, None, 4)},
    "a.{x,y}.c*": {"a.x.cpu": line(1, 2, None, 4), "a.y.cpu": line(10, 20, 30, None)},
    "?.x.[cm]*": {"a.x.cpu": line(1, 2, None, 4), "a.x.mem": line(5, 5, 5, 5), "b.x.cpu": line(7, 3, 9, 1)},
    "sumSeries(a.x.cpu, a.y.cpu)": {"sumSeries": line(11, 22, 30, 4)},
    "averageSeries(a.{x,y}.cpu)": {"averageSeries": line(5.5, 11, 30, 4)},
    "diffSeries(a.y.cpu, a.x.cpu)": {"diffSeries": line(9, 18, 30, -4)},
    "multiplySeries(a.x.cpu,a.y.cpu)": {"multiplySeries": line(10, 40, 30, 4)},
    "powSeries(a.x.cpu, a.x.mem)": {"powSeries": line(1, 32, 5, 1024)},
    "countSeries(a.*.cpu)": {"countSeries": line(4, 4, 4, 4)},
    "rangeOfSeries(a.x.*)": {"rangeOfSeries": line(4, 3, 0, 1)},
    "maxSeries(a.x.*)": {"maxSeries": line(5, 5, 5, 5)},
    "lastSeries(a.x.*)": {"lastSeries": line(5, 5, 5, 5)},
    "aggregate(a.x.*, 'median')": {"medianSeries": line(3, 3.5, 5, 4.5)},
    "percentileOfSeries(a.x.*, 50)": {"percentileOfSeries(50)": line(5, 5, 5, 5)},
    "groupByNode(a.*.cpu, 0, 'max')": {"a": line(10, 20, 30, 4)},
    "groupByNodes(*.x.*, 'sum', 0, 1)": {"a.x": line(6, 7, 5, 9), "b.x": line(7, 3, 9, 1)},
    "sumSeriesWithWildcards(*.x.cpu, 0)": {"x.cpu": line(8, 5, 9, 5)},
    "aggregateWithWildcards(a.x.*, 'min', 2)": {"a.x": line(1, 2, 5, 4)},
    "alias(divideSeries(a.y.cpu, a.x.cpu), 'r')": {"r": line(10, 10)},
    "alias(divideSeries(a.x.cpu, a.z10.cpu), 'r')": {},
    "aliasByNode(divideSeriesLists(a.{x,y}.cpu, a.{x,y}.cpu), 1)": {"x": line(1, 1, None, 1), "y": line(1, 1, 1)},
    "weightedAverage(a.{x,y}.cpu, a.x.mem, 1)": {"weightedAverage": line(1, 2, None, 4)},
    "asPercent(a.x.cpu, 10)": {"asPercent(a.x.cpu)": line(10, 20, None, 40)},
    "aliasByNode(asPercent(a.{x,y}.cpu), 1)": {"x": line(9.090909, 9.090909, None, 100), "y": line(90.909091, 90.909091, 100)},
    "scale(a.x.cpu, 2)": {"scale(a.x.cpu,2)": line(2, 4, None, 8)},
    "offset(a.x.cpu, -1.5)": {"offset(a.x.cpu,-1.5)": line(-0.5, 0.5, None, 2.5)},
    "alias(transformNull(a.x.cpu, 9), 't')": {"t": line(1, 2, 9, 4)},
    "alias(isNonNull(a.x.cpu), 't')": {"t": line(1, 1, 0, 1)},
    "alias(logarithm(a.y.cpu, 10), 't')": {"t": line(1, 1.30103, 1.477121)},
    "alias(derivative(a.x.cpu), 't')": {"t": {1: 1.0}},
    "alias(nonNegativeDerivative(b.x.cpu), 't')": {"t": {2: 6.0}},
    "alias(nonNegativeDerivative(b.x.cpu, 9), 't')": {"t": {1: 6.0, 2: 6.0, 3: 2.0}},
    "alias(perSecond(scale(a.x.cpu, 60)), 't')": {"t": {1: 1.0, 3: 1.0}},
    "alias(integral(a.x.cpu), 't')": {"t": line(1, 3, None, 7)},
    "alias(changed(a.x.cpu), 't')": {"t": line(0, 1, 0, 1)},
    "alias(keepLastValue(a.x.cpu), 't')": {"t": line(1, 2, 2, 4)},
    "alias(interpolate(a.x.cpu), 't')": {"t": line(1, 2, 3, 4)},
    "alias(movingAverage(b.x.cpu, 2), 't')": {"t": {1: 7.0, 2: 5.0, 3: 6.0}},
    "alias(movingMedian(b.x.cpu, '2min'), 't')": {"t": {1: 7.0, 2: 5.0, 3: 6.0}},
    "alias(stdev(b.x.cpu, 2, 1), 't')": {"t": {1: 2.0, 2: 3.0, 3: 4.0}},
    "alias(exponentialMovingAverage(b.x.cpu, 3), 't')": {"t": line(7, 5, 7, 4)},
    "alias(delay(b.x.cpu, 2), 't')": {"t": {2: 7.0, 3: 3.0}},
    "summarize(b.x.cpu, '2min')": {'summarize(b.x.cpu, "2min", "sum")': {0: 10.0, 2: 10.0}},
    "smartSummarize(b.x.cpu, '2min', 'max')": {'smartSummarize(b.x.cpu, "2min", "max")': {0: 7.0, 2: 9.0}},
    "summarize(b.x.cpu, '2min', 'last')": {'summarize(b.x.cpu, "2min", "last")': {0: 3.0, 2: 1.0}},
    "alias(hitcount(b.x.cpu, '2min'), 't')": {"t": {0: 600.0, 2: 600.0}},
    "alias(nPercentile(b.x.cpu, 50), 't')": {"t": line(7, 7, 7, 7)},
    "alias(removeAbovePercentile(b.x.cpu, 50), 't')": {"t": line(7, 3, None, 1)},
    "alias(removeBelowValue(b.x.cpu, 3), 't')": {"t": line(7, 3, 9)},
    "removeEmptySeries(a.z*.cpu, 0.5)": {"a.z10.cpu": line(0, 0)},
    "filterSeries(*.*.cpu, 'max', '>=', 9)": {"a.y.cpu": line(10, 20, 30), "b.x.cpu": line(7, 3, 9, 1)},
    "highest(a.*.cpu, 1, 'max')": {"a.y.cpu": line(10, 20, 30)},
    "lowest(a.*.cpu, 1, 'current')": {"a.z9.cpu": {3: -1.0}},
    "limit(sortByName(a.z*.cpu, natural=true), 1)": {"a.z9.cpu": {3: -1.0}},
    "limit(sortByName(a.z*.cpu), 1)": {"a.z10.cpu": line(0, 0)},
    "limit(sortBy(a.*.cpu, 'sum', true), 1)": {"a.y.cpu": line(10, 20, 30)},
    "exclude(a.*.cpu, 'z|y')": {"a.x.cpu": line(1, 2, None, 4)},
    "grep(a.*.cpu, 'y')": {"a.y.cpu": line(10, 20, 30)},
    "aliasSub(a.y.cpu, '^a.(.).*', 'n-\\1')": {"n-y": line(10, 20, 30)},
    "aliasByMetric(a.y.cpu)": {"cpu": line(10, 20, 30)},
    "aliasByNode(scale(a.y.cpu, 1), -1, 0)": {"cpu.a": line(10, 20, 30)},
    "group(a.y.cpu, b.x.cpu)": {"a.y.cpu": line(10, 20, 30), "b.x.cpu": line(7, 3, 9, 1)},
    "fallbackSeries(no.such.path, constantLine(3))": {"3": line(3, 3, 3, 3)},
    "fallbackSeries(a.y.cpu, constantLine(3))": {"a.y.cpu": line(10, 20, 30)},
    "identity('t')": {"t": line(0, 60, 120, 180)},
    "alias(timeShift(b.x.cpu, '1min'), 't')": {"t": {1: 7.0, 2: 3.0, 3: 9.0}},
    "applyByNode(*.x.cpu, 1, 'sumSeries(%.*)', '%.all')": {"a.x.all": line(6, 7, 5, 9), "b.x.all": line(7, 3, 9, 1)},
    "alias(sustainedAbove(b.x.cpu, 3, '2min'), 't')": {"t": line(7, 3, 9)},
    "alias(sustain(a.x.mem, '2min'), 't')": {"t": {1: 5.0, 2: 5.0, 3: 5.0}},
    "scaleToSeconds(a.x.mem, 120)": {"scaleToSeconds(a.x.mem,120)": line(10, 10, 10, 10)},
}


@pytest.mark.parametrize("target", CASES)
def test_target(renderer, target):
    assert run(renderer, target) == CASES[target]


def test_max_data_points(renderer):
    assert run(renderer, "b.x.cpu", max_points=2) == {"b.x.cpu": {0: 5.0, 2: 5.0}}


def test_aggregate_honours_the_share_of_series(renderer):
    full = line(11, 22, 30, 4)
    assert run(renderer, "aggregate(a.{x,y}.cpu, 'sum')") == {"sumSeries": full} == run(renderer, "aggregate(a.{x,y}.cpu, 'sum', 0.5)")
    assert run(renderer, "aggregate(a.{x,y}.cpu, 'sum', 0.6)") == {"sumSeries": line(11, 22)} == run(renderer, "aggregate(a.{x,y}.cpu, 'sum', xFilesFactor=1)")


@pytest.mark.parametrize("target", ["consolidateBy(a.x.cpu, 'sum')", "alias(consolidateBy(a.x.cpu, 'sum'), 'x')", "randomWalk('x')"])
def test_functions_that_are_not_built_are_unknown(renderer, target):
    with pytest.raises(TargetError, match="unknown function"):
        renderer.render(target, 0, 240 * SECOND, 60 * SECOND, max_points=2)


def test_find(renderer):
    assert {(r["path"], r["leaf"]) for r in renderer.find("a.x.*").collect()} == {("a.x.cpu", True), ("a.x.mem", True), ("a.x.cpu", False)}
    assert {r["text"] for r in renderer.find("*").collect()} == {"a", "b"}


def test_parsing():
    assert parse_target("f(a.b, 'x y', 2, true, k=1.5)") == Function("f", [Path("a.b"), "x y", 2, True], {"k": 1.5})
    for bad in ("f(", "f(a", "f)a", "'x", "f(a b)", "a,b"):
        with pytest.raises(TargetError):
            parse_target(bad)
    with pytest.raises(TargetError):
        Renderer.plan(object.__new__(Renderer), Function("nosuch", [], {}), None)


def test_paths_and_times():
    assert glob_to_regex("a.*.{b,c?}[0-9]") == r"a\.+[^\.]*\.+(?:b|c[^\.])[0-9]" or glob_to_regex("{b,c?}") == r"(?:b|c[^\.])"
    assert [m.op for m in path_matchers("a.b*.{x.y,z}")] == ["=", "=~", "=~", "="]
    assert parse_interval("1h30min") == 5400 * SECOND and parse_interval("-2d") == -172800 * SECOND
    assert parse_time("-1h", 10_000) == 6400 * SECOND and parse_time("1700000000") == 1_700_000_000 * SECOND and parse_time("20240229") == 1_709_164_800 * SECOND
    assert parse_time("12:30_20240229") == 1_709_209_800 * SECOND and parse_time("midnight+1h", 1_709_209_800) == 1_709_168_400 * SECOND
    for bad in ("x", ""):
        with pytest.raises(ValueError):
            parse_interval(bad)


@pytest.fixture(scope="module")
def lines(spark):
    rows = []
    for host, dc, vs in (("h1", "east", [1, 2, 3, 4]), ("h2", "east", [10, 20, 30, 40]), ("w1", "west", [5, 5, 5, 5])):
        rows += [({"__name__": "cpu", "host": host, "dc": dc}, i * 60 * SECOND, float(v)) for i, v in enumerate(vs)]
    rows += [({"__name__": "lat", "bucketid": "1", "bucket": b}, i * 60 * SECOND, float(c)) for b, c in (("0-10", 5), ("10-20", 3), ("20-infinity", 2)) for i in range(4)]
    return Pipes(SeriesSource(spark.createDataFrame(rows, "labels map<string,string>, ts bigint, value double")), lookback=30 * SECOND)


PIPES = {
    "fetch name:cpu host:h*": {'cpu{dc="east",host="h1"}': line(1, 2, 3, 4), 'cpu{dc="east",host="h2"}': line(10, 20, 30, 40)},
    "fetch name:cpu | sum dc | scale 2": {'{dc="east"}': line(22, 44, 66, 88), '{dc="west"}': line(10, 10, 10, 10)},
    "fetch name:cpu host:!h1 | max": {"{}": line(10, 20, 30, 40)},
    "east = fetch name:cpu dc:east; east | avg | > 6": {"{}": {1: 11.0, 2: 16.5, 3: 22.0}},
    "fetch name:cpu | excludeByTag host h* | offset -5 # a comment": {'cpu{dc="west",host="w1"}': line(0, 0, 0, 0)},
    "fetch name:cpu host:w1 | alias flat": {'flat{dc="west",host="w1"}': line(5, 5, 5, 5)},
    "fetch name:cpu | aliasByTags dc host | head 1": {'east h1{dc="east",host="h1"}': line(1, 2, 3, 4)},
    "fetch name:cpu host:h1 | derivative": {'cpu{dc="east",host="h1"}': {1: 1.0, 2: 1.0, 3: 1.0}},
    "fetch name:cpu host:h1 | moving 2 sum": {'cpu{dc="east",host="h1"}': {1: 1.0, 2: 3.0, 3: 5.0}},
    "fetch name:cpu | intersect (fetch name:cpu dc:west) dc": {'cpu{dc="west",host="w1"}': line(5, 5, 5, 5)},
    "fetch name:cpu | setDiff (fetch name:cpu dc:east) host": {'cpu{dc="west",host="w1"}': line(5, 5, 5, 5)},
    "fetch name:cpu dc:east | asPercent": {'{dc="east",host="h1"}': line(9.090909, 9.090909, 9.090909, 9.090909), '{dc="east",host="h2"}': line(90.909091, 90.909091, 90.909091, 90.909091)},
    "fetch name:lat | histogramPercentile bucketid bucket 50": {"{}": line(10, 10, 10, 10)},
    "fetch name:lat | histogramCDF bucketid bucket 15": {"{}": line(0.65, 0.65, 0.65, 0.65)},
    "fetch name:nosuch | fallbackSeries 7": {"{}": line(7, 7, 7, 7)},
    "fetch name:cpu | range dc": {'{dc="east"}': line(9, 18, 27, 36), '{dc="west"}': line(0, 0, 0, 0)},
    "fetch name:cpu dc:east | diff": {"{}": line(-9, -18, -27, -36)},
    "fetch name:cpu dc:east | percentileOfSeries 50 false": {"{}": line(10, 20, 30, 40)},
    "constantLine 4 | sqrt": {"{}": line(2, 2, 2, 2)},
    "execute (fetch name:cpu host:w1) | abs": {'cpu{dc="west",host="w1"}': line(5, 5, 5, 5)},
}


@pytest.mark.parametrize("text", PIPES)
def test_pipe(lines, text):
    got = {}
    for r in pipes.rendered(lines.query(text, 0, 180, 60)).collect():
        got.setdefault(r["series"], {})[r["step"] // (60 * SECOND)] = round(r["value"], 6) + 0.0
    assert got == PIPES[text]


def test_pipe_errors(lines):
    for bad in ("", "| sum", "fetch name:cpu |", "fetch (", "x = fetch a:b", "fetch name:cpu | nosuch", "sum dc", "fetch name:cpu )"):
        with pytest.raises(pipes.PipeError):
            lines.query(bad, 0, 180, 60)


@pytest.mark.parametrize("text", ["fetch name:cpu host:h1 | timeshift 1min | scale 10", "fetch name:cpu host:h1 | scale 10 | timeshift 1min"])
def test_pipe_timeshift(lines, text):
    got = {r["step"] // (60 * SECOND): r["value"] for r in lines.query(text, 0, 180, 60).collect()}
    assert got == {1: 10.0, 2: 20.0, 3: 30.0}
