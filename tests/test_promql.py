"""The expression language: parsing, and evaluation over small series with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidewheel.operators.frames import SECOND, Matcher, SeriesSource, anchored, fan_out
from tidewheel.plans import promql_parser as p
from tidewheel.plans.promql import Engine, PlanError, rendered


def series(name, labels, points):
    return [({**labels, "__name__": name}, round(t * SECOND), float(v)) for t, v in points]


#: what flows through five tanks: site, tank, grade, and the last two readings (at about 2377 and 2951 s)
FLOWS = [("north", "a", "raw", 5, 7), ("north", "b", "clean", 11, 19), ("north", "c", "raw", 40, 42), ("south", "a", "clean", 90, 130), ("south", "b", "raw", 2, 3)]
#: readings at irregular times: a counter that starts anew twice, a gauge with a gap, a straight line over time, a staircase
METER = list(zip([40, 350, 610, 1020, 1300, 1655, 1990, 2210, 2530, 2760, 2990], [3, 9, 14, 2, 6, 1, 8, 8, 15, 21, 30]))
LEVEL = list(zip([95, 380, 700, 1600, 1890, 2200, 2440, 2700, 2930], [2, 2, 5, 9, 9, 4, 6, 6, 6]))
DRIFT = [(t, 4 + 0.02 * t) for t in (130, 410, 777, 1500, 2222, 2990)]
STAIRS = list(zip([10, 600, 655, 1400, 2000, 2800], [1, 4, 7, 10, 13, 16]))


@pytest.fixture(scope="module")
def engine(spark):
    rows = []
    for i, (site, tank, grade, before, last) in enumerate(FLOWS):
        rows += series("flow", {"site": site, "tank": tank, "grade": grade}, [(61 + 7 * i, 0.5), (333 + 11 * i, 2), (905 + 3 * i, 1.25), (1499 + i, 6), (2377 - i, before), (2951 + i, last)])
    rows += series("meter", {}, METER) + series("level", {"tank": "a"}, LEVEL) + series("drift", {}, DRIFT) + series("stairs", {}, STAIRS)
    for le, c in (("1.5", 6), ("4", 6), ("25", 15), ("+Inf", 20)):
        rows += series("wait_bucket", {"le": le}, [(2800, c)])
    for le, c in (("2", 8), ("3", 4), ("10", 9), ("+Inf", 12)):
        rows += series("odd_bucket", {"le": le}, [(2900, c)])
    rows += series("special", {"k": "nan"}, [(2950, math.nan)]) + series("special", {"k": "inf"}, [(2950, math.inf)]) + series("special", {"k": "neg"}, [(2950, -2.25)])
    return Engine(SeriesSource(spark.createDataFrame(rows, "labels map<string,string>, ts bigint, value double")))


CASES = {
    "sum(flow)": {"{}": 201},
    "sum by (site) (flow)": {'{site="north"}': 68, '{site="south"}': 133},
    "sum(flow) without (tank, grade)": {'{site="north"}': 68, '{site="south"}': 133},
    "count(flow)": {"{}": 5},
    "avg by (grade) (flow)": {'{grade="raw"}': 52 / 3, '{grade="clean"}': 74.5},
    "min(flow)": {"{}": 3},
    "max by (site) (flow)": {'{site="north"}': 42, '{site="south"}': 130},
    "stdvar(flow)": {"{}": 2200.56},
    "quantile(0.5, flow)": {"{}": 19},
    "quantile(0.9, flow)": {"{}": 94.8},
    "quantile(-1, flow)": {"{}": -math.inf},
    "quantile(2, flow)": {"{}": math.inf},
    'topk(1, flow{site="north"})': {'flow{grade="raw",site="north",tank="c"}': 42},
    "bottomk by (site) (1, flow)": {'flow{grade="raw",site="north",tank="a"}': 7, 'flow{grade="raw",site="south",tank="b"}': 3},
    'count_values("v", flow{tank!="c"} > bool 10)': {'{v="0"}': 2, '{v="1"}': 2},
    'flow{site=~"nor.*",grade!="clean",tank=~"c|x"}': {'flow{grade="raw",site="north",tank="c"}': 42},
    'flow{site!~"north",tank="b",grade=~".+",nosuch=""}': {'flow{grade="raw",site="south",tank="b"}': 3},
    'sum(flow{site=~"s.ut."} offset 10m)': {"{}": 92},
    "absent(nosuch)": {"{}": 1},
    'absent(nosuch{site="x",k=~"y"})': {'{site="x"}': 1},
    "absent(flow)": {},
    "rate(meter[50m])": {"{}": 47 / 2950},
    "increase(meter[50m])": {"{}": 47 * 3000 / 2950},
    "delta(meter[50m])": {"{}": 27 * 3000 / 2950},
    "irate(meter[50m])": {"{}": 9 / 230},
    "idelta(meter[50m])": {"{}": 9},
    "resets(meter[50m])": {"{}": 2},
    "changes(meter[50m])": {"{}": 9},
    "changes(level[50m])": {'{tank="a"}': 4},
    "sum_over_time(level[20m])": {'{tank="a"}': 31},
    "count_over_time(level[50m])": {'{tank="a"}': 9},
    "avg_over_time(meter[10m])": {"{}": 22},
    "min_over_time(meter[50m])": {"{}": 1},
    "max_over_time(meter[50m])": {"{}": 30},
    "last_over_time(level[4m])": {'level{tank="a"}': 6},
    "quantile_over_time(0.5, meter[50m])": {"{}": 8},
    "stdvar_over_time(meter[10m])": {"{}": 38},
    "stddev_over_time(meter[3m])": {},
    "present_over_time(meter[50m])": {"{}": 1},
    "deriv(drift[50m])": {"{}": 0.02},
    "predict_linear(drift[50m], 3000)": {"{}": 124},
    "holt_winters(stairs[50m], 0.5, 0.5)": {"{}": 16},
    "max_over_time(increase(meter[10m])[30m:5m])": None,
    "histogram_quantile(0.9, wait_bucket)": {"{}": 25},
    "histogram_quantile(0.3, wait_bucket)": {"{}": 1.5},
    "histogram_quantile(0.15, wait_bucket)": {"{}": 0.75},
    "histogram_quantile(0.5, wait_bucket)": {"{}": 4 + 21 * 4 / 9},
    "histogram_quantile(1, wait_bucket)": {"{}": 25},
    "histogram_quantile(2, wait_bucket)": {"{}": math.inf},
    "histogram_quantile(0.5, odd_bucket)": {"{}": 1.5},
    "histogram_quantile(0.7, odd_bucket)": {"{}": 5.8},
    'histogram_quantile(0.8, wait_bucket{le=~"1.5|4"})': {},
    "1 + 2 * 3 ^ 2 ^ 0 - 4 / 2": {"{}": 5},
    "-2 ^ 2": {"{}": -4},
    "7 % 4": {"{}": 3},
    "-7 % 4": {"{}": -3},
    "1 / 0": {"{}": math.inf},
    "0 / 0": {"{}": math.nan},
    "1 > bool 2": {"{}": 0},
    "time()": {"{}": 3000},
    "vector(3)": {"{}": 3},
    'special{k="inf"} - special{k="inf"}': {'{k="inf"}': math.nan},
    'abs(special{k="neg"})': {'{k="neg"}': 2.25},
    'ceil(special{k!="nan"})': {'{k="neg"}': -2, '{k="inf"}': math.inf},
    'floor(special{k="neg"})': {'{k="neg"}': -3},
    'round(special{k="neg"})': {'{k="neg"}': -2},
    'sqrt(special{k="neg"})': {'{k="neg"}': math.nan},
    "ln(vector(0))": {"{}": -math.inf},
    "log2(vector(8))": {"{}": 3},
    "log10(vector(-1))": {"{}": math.nan},
    "exp(vector(0))": {"{}": 1},
    "sgn(vector(-9))": {"{}": -1},
    "clamp_max(clamp_min(vector(5), 7), 6)": {"{}": 6},
    "round(vector(7.28), 0.5)": {"{}": 7.5},
    "day_of_week(vector(1709208000))": {"{}": 4},
    "days_in_month(vector(1709208000))": {"{}": 29},
    "day_of_month(vector(1709208000))": {"{}": 29},
    "month(vector(1709208000))": {"{}": 2},
    "year(vector(1709208000))": {"{}": 2024},
    "hour(vector(1709208000))": {"{}": 12},
    "minute(vector(1709208060))": {"{}": 1},
    "hour(vector(-1))": {"{}": 23},
    'flow{site="north"} * on (tank) flow{site="south"}': {'{tank="a"}': 910, '{tank="b"}': 57},
    'flow{site="north"} / ignoring (site, grade) flow{site="south"}': {'{grade="raw",site="north",tank="a"}': 7 / 130, '{grade="clean",site="north",tank="b"}': 19 / 3},
    'flow{site="south"} / on (site) group_left () sum by (site) (flow)': {'{grade="clean",site="south",tank="a"}': 130 / 133, '{grade="raw",site="south",tank="b"}': 3 / 133},
    'sum by (tank) (flow) * on (tank) group_right (nosuch) flow{site="south"}': {'{grade="clean",site="south",tank="a"}': 137 * 130, '{grade="raw",site="south",tank="b"}': 22 * 3},
    "flow > 100": {'{grade="clean",site="south",tank="a"}': 130},
    "100 < flow": {'{grade="clean",site="south",tank="a"}': 100},
    'flow{site="south"} and on (tank) (flow{site="north"} > 10)': {'flow{grade="raw",site="south",tank="b"}': 3},
    'flow{site="north"} unless on (tank) flow{site="south"}': {'flow{grade="raw",site="north",tank="c"}': 42},
    "sum by (site) (flow) or sum by (grade) (flow)": {'{site="north"}': 68, '{site="south"}': 133, '{grade="raw"}': 52, '{grade="clean"}': 149},
    'label_replace(sum by (site) (flow), "j", "<$1>", "site", "n(..)th")': {'{j="<or>",site="north"}': 68, '{site="south"}': 133},
    'label_join(sum by (site, tank) (flow{site="south"}), "x", "/", "site", "tank", "nosuch")': {'{site="south",tank="a",x="south/a"}': 130, '{site="south",tank="b",x="south/b"}': 3},
    'label_join(sum by (site) (flow{site="north"}), "x", "/", "site")': {'{site="north"}': 68},
    "timestamp(level)": {'{tank="a"}': 3000},
    "-level": {'{tank="a"}': -6},
    "sum(special)": {"{}": math.inf},
    "max(special)": {"{}": math.inf},
}


@pytest.mark.parametrize("query", CASES)
def test_instant(engine, query):
    got = {r["series"]: r["value"] for r in rendered(engine.query_instant(query, 3000)).collect()}
    want = CASES[query]
    if want is None:
        assert len(got) == 1
        return
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9, nan_ok=True), (query, k)


def test_lookback_and_range(engine):
    rows = rendered(engine.query_range("level", 900, 1800, 60)).orderBy("step").collect()
    # the reading at 700 s is taken until 1000 s, then nothing until 1600 s
    assert [(r["step"] // SECOND, r["value"]) for r in rows] == [(900, 5.0), (960, 5.0), (1620, 9.0), (1680, 9.0), (1740, 9.0), (1800, 9.0)]


def test_windows_are_closed_at_both_ends(engine):
    assert rendered(engine.query_instant("count_over_time(meter[460s])", 2990)).collect()[0]["value"] == 3


def test_sorted_instant(engine):
    got = [r["value"] for r in rendered(engine.query_instant("sort_desc(flow)", 3000)).collect()]
    assert got == [130, 42, 19, 7, 3]


def test_upstream_rules(engine):
    e = Engine(engine.source, compat="prom")
    assert rendered(e.query_instant("scalar(sum(flow)) + vector(1)", 3000)).collect()[0]["value"] == 202
    assert math.isnan(rendered(e.query_instant("vector(scalar(flow))", 3000)).collect()[0]["value"])
    assert rendered(e.query_instant("sum(flow offset -5m)", 2700)).collect()[0]["value"] == 201
    assert rendered(e.query_instant('label_replace(sum by (site) (flow{site="north"}), "j", "x", "site", "o")', 3000)).collect()[0]["series"] == '{site="north"}'


def test_series_with_null_labels_stay_apart(spark):
    rows = [("x", None, 1 * SECOND, 1.0), (None, "x", 1 * SECOND, 2.0), ("x", None, 2 * SECOND, 3.0), ("", "x", 2 * SECOND, 4.0), (None, None, 2 * SECOND, 5.0)]
    source = SeriesSource(spark.createDataFrame(rows, "a string, b string, ts bigint, value double"), {"a": "a", "b": "b"}, name="m")
    got = {r["series"]: r["value"] for r in rendered(Engine(source).query_instant('sum_over_time(m[1m])', 10)).collect()}
    assert got == {'{a="x"}': 4.0, '{b="x"}': 6.0, "{}": 5.0}
    maps = [({"__name__": "m", **k}, t, v) for k, t, v in (({"a": "x", "b": None}, 1, 1.0), ({"a": "x", "b": ""}, 2, 2.0), ({"a": "x"}, 3, 3.0), ({"b": "x"}, 3, 9.0))]
    source = SeriesSource(spark.createDataFrame(maps, "labels map<string,string>, ts bigint, value double"))
    assert sorted(r["value"] for r in rendered(Engine(source).query_instant('sum_over_time(m[1m])', 10)).collect()) == [6.0, 9.0]
    both = fan_out([source, SeriesSource(spark.createDataFrame([({"__name__": "m", "a": "x"}, 3, 7.0), ({"__name__": "m", "b": "x", "a": None}, 4, 8.0)], "labels map<string,string>, ts bigint, value double"))], [])[0]
    assert sorted(r["value"] for r in both.collect()) == [1.0, 2.0, 3.0, 8.0, 9.0]


def test_moments_do_not_cancel(spark):
    """Small deviations of large values, far from the grid's start."""
    rows = [({"__name__": "m"}, (10**6 + 7 * i) * SECOND, 1e9 + (i % 5)) for i in range(400)]
    e = Engine(SeriesSource(spark.createDataFrame(rows, "labels map<string,string>, ts bigint, value double")))
    for step in (10**6 + 1400, 10**6 + 2800):
        inside = [(t / SECOND, v) for _, t, v in rows if step - 1000 <= t / SECOND <= step]
        mt, mv = (sum(x) / len(inside) for x in zip(*inside))
        slope = sum((t - mt) * (v - mv) for t, v in inside) / sum((t - mt) ** 2 for t, _ in inside)
        for q, want in (("stdvar_over_time(m[1000s])", sum((v - mv) ** 2 for _, v in inside) / len(inside)), ("deriv(m[1000s])", slope), ("predict_linear(m[1000s], 60)", mv + slope * (step + 60 - mt))):
            rows_ = e.query_range(q, 10**6, 10**6 + 2800, 100).where(F.col("step") == step * SECOND).collect()
            assert rows_[0]["value"] == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("bad", ["", "sum(", "flow[5m", "{}", '{a=~".*"}', "a{b=c}", "1 +", "a offset x", "sum by flow", "a == bool", "topk(flow)", 'a{b=~"("}', "a b"])
def test_syntax_errors(bad):
    with pytest.raises(p.ParseError):
        p.parse(bad)


@pytest.mark.parametrize("bad", ["flow[5m]", "rate(flow)", "1 > 2", "flow and 1", "nosuchfn(flow)", '"text"', "sum(1)", "flow offset -5m", "holt_winters(flow[5m], 2, 0.5)", "round()"])
def test_plan_errors(engine, bad):
    with pytest.raises((PlanError, ValueError)):
        engine.query_instant(bad, 3000)


def test_parse_roundtrip_and_threshold():
    for q in CASES:
        assert p.parse(p.unparse(p.parse(q))) == p.parse(q)
    assert p.threshold("5 < sum(x)") == ("sum (x)", ">", 5.0)
    assert p.threshold("rate(x[1m]) >= 2") == ("rate(x[1m])", ">=", 2.0)
    with pytest.raises(p.ParseError):
        p.threshold("a > b")


def test_label_interface(engine):
    s = engine.source
    assert {r["label"] for r in s.label_names([Matcher("__name__", "=", "flow")]).collect()} == {"__name__", "site", "tank", "grade"}
    assert {r["value"] for r in s.label_values("site").collect()} == {"north", "south"}
    assert {r["label"]: r["values"] for r in s.complete_tags([Matcher("site", "=", "south")], "site|grade").collect()} == {"site": ["south"], "grade": ["clean", "raw"]}
    assert anchored("^a|b$") == "^(?:a|b)$"
    only = Engine(s.restricted([Matcher("site", "=", "north")], ["tank"]))
    assert rendered(only.query_instant("max by (site, tank) (flow)", 3000)).collect()[0].asDict() == {"series": '{site="north"}', "step": 3000 * SECOND, "value": 42.0}


def test_no_samples(spark):
    e = Engine(SeriesSource(spark.createDataFrame([], "labels map<string,string>, ts bigint, value double")))
    for q in ("x", "rate(x[5m])", "sum(x)", "x + x", "histogram_quantile(0.5, x)", "topk(3, x)", "holt_winters(x[5m], 0.1, 0.1)"):
        assert e.query_range(q, 0, 600, 60).count() == 0


def test_pushdown_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "ts bigint, value double, kind string").write.parquet(str(tmp_path / "t"))
    e = Engine(SeriesSource(spark.read.parquet(str(tmp_path / "t")), {"kind": "kind"}, name="m"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = e.query_range('m{kind="a"}', 0, 600, 60)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(kind,a)" in plan and "GreaterThanOrEqual(ts" in plan
