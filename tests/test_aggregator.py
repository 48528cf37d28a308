"""Aggregation types, pipelines, rules and the streaming form."""

import math

import pytest
from pyspark.sql import functions as F

from tidewheel.aggregator import pipeline as ap
from tidewheel.aggregator.rules import MappingRule, RollupRule, RuleError, RuleSet, filter_column, filter_regex, parse_filter, validate
from tidewheel.aggregator.types import StoragePolicy, duration, output_name, parse_types
from tidewheel.operators.frames import SECOND
from tidewheel.streaming import aggregator as st

SCHEMA = "id string, labels map<string,string>, kind string, ts bigint, value double"
S = SECOND


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, k, t * S, v) for i, lab, k, t, v in rows], SCHEMA)


def points(df):
    return {(r["id"], tuple(sorted(r["labels"].items())), r["agg"], r["ts"] // S): r["value"] for r in df.collect()}


def test_windows_and_types(spark):
    df = frame(spark, [("g", {"a": "1"}, "gauge", 1, 5.0), ("g", {"a": "1"}, "gauge", 9, 7.0), ("g", {"a": "1"}, "gauge", 5, math.nan), ("g", {"a": "1"}, "gauge", 10, 1.0), ("g", {}, "gauge", 3, math.nan)])
    got = points(ap.windowed(df, 10 * S, ["Last", "Min", "Max", "Mean", "Count", "Sum", "SumSq", "Stdev", "Median", "P99"]))
    a = (("a", "1"),)
    want = {"Last": 7, "Min": 5, "Max": 7, "Mean": 6, "Count": 3, "Sum": 12, "SumSq": 74, "Stdev": math.sqrt(2), "Median": 6, "P99": 6.98}
    for t, v in want.items():
        assert got["g", a, t, 10] == pytest.approx(v)
    assert got["g", a, "Stdev", 20] == 0 and got["g", a, "Count", 20] == 1
    # only NaN: counts, no extremes
    assert got["g", (), "Count", 10] == 1 and ("g", (), "Max", 10) not in got and got["g", (), "Sum", 10] == 0
    assert {t for _, _, _, t in points(ap.windowed(df, 10 * S, ["Sum"], forwarded=True))} == {0, 10}


def test_default_types_and_names(spark):
    df = frame(spark, [("c", {}, "counter", 1, 2.0), ("c", {}, "counter", 2, 3.0), ("t", {}, "timer", 1, 4.0), ("g", {}, "gauge", 1, 9.0)])
    got = points(ap.windowed(df, 60 * S))
    assert got["c", (), "Sum", 60] == 5 and got["g", (), "Last", 60] == 9 and got["t", (), "P95", 60] == 4
    assert {a for i, _, a, _ in got if i == "c"} == {"Sum"} and len([1 for i, *_ in got if i == "t"]) == 11
    assert output_name("counter", "x", "Sum") == "stats.counts.x" and output_name("timer", "x", "P99") == "stats.timers.x.p99" and output_name("gauge", "x", "SumSq") == "stats.gauges.x.sum_sq"
    assert parse_types("p99, Sum,median") == ["P99", "Sum", "Median"]
    with pytest.raises(ValueError):
        parse_types("P98")


def test_values_of_records(spark):
    df = spark.createDataFrame([("timer", None, [1.0, 2.0], None), ("timer", None, [], None), ("timer", None, None, None), ("gauge", None, None, 3.0), ("gauge", None, None, None), ("counter", 4, None, None), (None, None, None, None)], "type string, counter_val bigint, batch_timer array<double>, gauge_val double")
    assert sorted((r["kind"], r["value"]) for r in ap.values_of(df).collect()) == [("counter", 4.0), ("gauge", 3.0), ("timer", 1.0), ("timer", 2.0)]


def test_policies():
    p = StoragePolicy.parse("10s@1s:2d")
    assert (p.resolution, p.retention, p.precision) == (10 * S, 172800 * S, S) and str(StoragePolicy.parse("1m:48h")) == "1m:2d"
    assert duration("1h30m") == 5400 * S
    for bad in ("1m", "x:1h", "1m:", "1:2"):
        with pytest.raises(ValueError):
            StoragePolicy.parse(bad)


@pytest.mark.parametrize("name,want", [("Absolute", {10: 5, 20: 3, 30: 8}), ("Add", {10: -5, 20: -2, 30: 6}), ("PerSecond", {20: 0.8, 30: 0.5}), ("Increase", {20: 8, 30: 5}), ("Reset", {10: -5, 15: 0, 20: 3, 25: 0, 30: 8, 35: 0})])
def test_transforms(spark, name, want):
    df = frame(spark, [("c", {}, "counter", 1, -5.0), ("c", {}, "counter", 11, 3.0), ("c", {}, "counter", 25, 8.0)])
    got = points(ap.run(df, ap.Pipeline([ap.Aggregate(("Sum",)), ap.Transform(name)]), 10 * S))
    assert {t: v for (_, _, _, t), v in got.items()} == pytest.approx(want)


def test_falling_values_give_nothing(spark):
    df = frame(spark, [("c", {}, "counter", 1, 9.0), ("c", {}, "counter", 11, 3.0)])
    for name, n in (("Increase", 1), ("PerSecond", 0)):
        assert ap.run(df, ap.Pipeline([ap.Aggregate(("Sum",)), ap.Transform(name)]), 10 * S).count() == n


def test_rollups(spark):
    df = frame(spark, [("r", {"app": "a", "host": "1"}, "counter", 1, 1.0), ("r", {"app": "a", "host": "2"}, "counter", 2, 2.0), ("r", {"host": "3"}, "counter", 3, 4.0)])
    by = points(ap.run(df, ap.Pipeline([ap.Aggregate(("Sum",)), ap.Rollup("all_{{ .MetricName }}", ("app",))]), 10 * S))
    assert by == {("all_r", (("__rollup__", "true"), ("app", "a")), "Sum", 10): 3.0}
    out = points(ap.run(df, ap.Pipeline([ap.Rollup("x", ("host",), exclude=True, types=("Sum", "Count"))]), 10 * S))
    assert out[("x", (("__rollup__", "true"),), "Sum", 10)] == 4 and out[("x", (("__rollup__", "true"), ("app", "a")), "Count", 10)] == 2


def test_lateness_and_repeats(spark):
    df = spark.createDataFrame([(1, 0, 700), (2, 0, 500), (3, 100, 10), (4, 50, 10), (4, 50, 11)], "id int, t int, a int").select("id", (F.col("t") * S).alias("ts"), (F.col("a") * S).alias("arrived"))
    assert sorted(r["id"] for r in ap.timely(df, "arrived", 600 * S, 60 * S).collect()) == [2, 4, 4]
    assert ap.first_deliveries(df, ["id", "ts"]).count() == 4


def test_filters(spark):
    df = spark.createDataFrame([("cpu.total", {"app": "web", "dc": "e1"}), ("mem", {"app": "db"}), ("mem", {})], "id string, labels map<string,string>")

    def hits(text, any_=False):
        return [r[0] for r in df.where(filter_column(text, any_)).select(F.concat("id", F.coalesce(F.expr("labels['app']"), F.lit("")))).collect()]

    assert hits("app:w*") == ["cpu.totalweb"] and hits("app:!w*") == ["memdb", "mem"] and hits("app:*") == ["cpu.totalweb", "memdb"]
    assert hits("name:{cpu.*,x} dc:e?") == ["cpu.totalweb"] and hits("dc:e[0-9] app:db", any_=True) == ["cpu.totalweb", "memdb"] and hits("dc:[!e]1") == []
    assert filter_regex("a{b,c*}?") == "a(?:b|c.*)."
    for bad in ("app", "app:", ":x", "a:1 a:2", "a:[x", "a:{x"):
        with pytest.raises(RuleError):
            parse_filter(bad)


def test_rule_versions_and_matching(spark):
    m = StoragePolicy.parse
    rs = RuleSet()
    rs.add(MappingRule("web", "app:web", [m("10s:2d")], ("Sum",)))
    rs.add(MappingRule("no", "app:noise", drop="must"))
    rs.add(MappingRule("only", "app:d*", drop="if-only-match"))
    rs.update(MappingRule("web", "app:web", [m("1m:40d")]), 100)
    rs.delete("no", 200)
    rs.revive("no", 300)
    df = spark.createDataFrame([("x", {"app": a}) for a in ("web", "noise", "db", "else")], "id string, labels map<string,string>")

    def at(t):
        return {r["labels"]["app"]: (r["policies"], r["dropped"]) for r in rs.matched(df, t).collect()}

    assert at(0) == {"web": (["10s:2d"], False), "noise": (["1m:2d"], True), "db": (["1m:2d"], True), "else": (["1m:2d"], False)}
    assert at(150)["web"] == (["1m:40d"], False) and at(250)["noise"][1] is False and at(300)["noise"][1] is True
    with pytest.raises(RuleError):
        rs.delete("nosuch", 1)
    with pytest.raises(RuleError):
        rs.revive("web", 400)
    before = list(rs.rules)
    with pytest.raises(RuleError):
        rs.bulk([("delete", "web", 500), ("delete", "nosuch", 500)])
    assert rs.rules == before
    for bad in (MappingRule("", "a:b", [m("1m:1h")]), MappingRule("q", "a:b"), MappingRule("q", "a:b", [m("1m:1h")], drop="must"), MappingRule("q", "a:b", drop="maybe"), RollupRule("q", "a:b", ap.Pipeline([])), RollupRule("q", "a:b", ap.Pipeline([ap.Rollup("x", ("a", "a"))]), [m("1m:1h")])):
        with pytest.raises(RuleError):
            validate([bad])


def test_rollup_rules(spark):
    rs = RuleSet()
    rs.add(RollupRule("sum", "app:*", ap.Pipeline([ap.Aggregate(("Sum",)), ap.Rollup("by_app", ("app",))]), [StoragePolicy.parse("10s:2d"), StoragePolicy.parse("1m:2d")]))
    df = frame(spark, [("r", {"app": "a", "h": "1"}, "counter", 1, 1.0), ("r", {"app": "a", "h": "2"}, "counter", 15, 2.0), ("r", {"h": "2"}, "counter", 15, 2.0)])
    got = {(r["policy"], r["ts"] // S): r["value"] for r in rs.rollups(df, 0).collect()}
    assert got == {("10s:2d", 10): 1.0, ("10s:2d", 20): 2.0, ("1m:2d", 60): 3.0}
    assert RuleSet().rollups(df, 0) is None


def test_tiles(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 59, 3.0), (1, 60, 7.0), (1, 61, math.nan), (2, 5, None)], "sid int, t int, value double").select("sid", (F.col("t") * S).alias("ts"), "value")
    assert sorted((r["sid"], r["ts"] // S, r["value"]) for r in ap.tiles(df, 60 * S).collect()) == [(1, 60, 3.0), (1, 120, 7.0)]


def write(spark, path, rows):
    cols = "id string, labels map<string,string>, kind string, ts bigint, value double, arrived bigint, source string, version int"
    spark.createDataFrame([(i, {"app": "a"}, "counter", t * S, float(v), a * S, s, n) for i, t, v, a, s, n in rows], cols).coalesce(1).write.mode("append").parquet(path)
    return cols


def test_stream_of_windows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = write(spark, src, [("m", 1, 1, 1, "s", 1), ("m", 8, 2, 8, "s", 1), ("m", 12, 4, 12, "s", 1), ("m", 500, 9, 1, "s", 1)])

    def go():
        stream = spark.readStream.schema(schema).parquet(src)
        st.write_flushed(st.windowed_stream(stream, 10 * S, ["Sum", "Count"], past=20 * S), out, str(tmp_path / "cp")).awaitTermination()
        return {(r["agg"], r["ts"] // S): r["value"] for r in spark.read.option("recursiveFileLookup", "true").parquet(out).collect()}

    assert go() == {}  # no window is closed yet; the value from the future is rejected
    write(spark, src, [("m", 9, 8, 13, "s", 1), ("m", 60, 1, 60, "s", 1)])  # in time
    go()
    write(spark, src, [("m", 3, 100, 61, "s", 1), ("m", 61, 1, 61, "s", 1)])  # too late
    got = go()
    assert got["Sum", 10] == 11.0 and got["Count", 10] == 3 and got["Sum", 20] == 4.0


def test_stream_without_repeats(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = write(spark, src, [("m", 1, 1, 1, "s", 1), ("m", 1, 1, 2, "s", 1), ("m", 1, 1, 2, "s", 2), ("m", 1, 1, 2, "t", 1)])
    q = st.write_flushed(st.without_repeats(spark.readStream.schema(schema).parquet(src)), out, str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.option("recursiveFileLookup", "true").parquet(out).count() == 3


def test_stream_of_increases_with_corrections(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def add(rows):
        spark.createDataFrame([("m", {"a": "b"}, t * S, float(v)) for t, v in rows], "id string, labels map<string,string>, ts bigint, value double").coalesce(1).write.mode("append").parquet(src)

    def go():
        stream = spark.readStream.schema("id string, labels map<string,string>, ts bigint, value double").parquet(src)
        st.write_flushed(st.increases(stream), out, str(tmp_path / "cp")).awaitTermination()
        return sorted((r["ts"] // S, r["value"]) for r in spark.read.option("recursiveFileLookup", "true").parquet(out).collect())

    add([(10, 5), (20, 8)])
    assert go() == [(10, 5.0), (20, 3.0)]
    add([(10, 6), (30, 9)])  # the first window corrected: its own change and the next one's come again
    assert go() == [(10, 5.0), (10, 6.0), (20, 2.0), (20, 3.0), (30, 1.0)]


def test_merge_corrections(spark):
    df = spark.createDataFrame([("m", {"a": "b"}, "counter", "Sum", 10, 1.0, 0), ("m", {"a": "b"}, "counter", "Sum", 10, 2.0, 1), ("m", {"a": "b"}, "counter", "Sum", 20, 3.0, 0)], "id string, labels map<string,string>, kind string, agg string, ts int, value double, batch int")
    assert sorted((r["ts"], r["value"]) for r in st.merge_corrections(df).collect()) == [(10, 2.0), (20, 3.0)]
