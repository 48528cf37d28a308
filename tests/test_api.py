"""The deployment's interface and the sinks."""

import json

import pytest

from tidewheel.api import WRITERS, Api
from tidewheel.operators.frames import SECOND, SeriesSource
from tidewheel.plans.promql_parser import ParseError
from tidewheel.sources import sinks


@pytest.fixture(scope="module")
def api(spark):
    rows = [({"__name__": "m", "__g0__": "a", "__g1__": h, "h": h}, i * 60 * SECOND, float(i + k)) for k, h in enumerate(("x", "y", "z")) for i in range(5)]
    return Api(SeriesSource(spark.createDataFrame(rows, "labels map<string,string>, ts bigint, value double")))


def test_queries_and_json(api):
    doc = json.loads(api.query_range_json('sum by (h) (m{h!="z"})', 0, 120, 60))
    assert {r["metric"]["h"]: r["values"] for r in doc["data"]["result"]} == {"x": [[0, "0"], [60, "1"], [120, "2"]], "y": [[0, "1"], [60, "2"], [120, "3"]]}
    assert json.loads(api.query_instant_json("sum(m)", 60))["data"]["result"][0]["value"] == [60, "6"]
    few = Api(api.source, max_series=2)
    assert "warnings" in json.loads(few.query_instant_json("m", 60))
    with pytest.raises(ValueError):
        Api(api.source, max_series=2, require_exhaustive=True).query_instant_json("m", 60)


def test_listings(api):
    assert api.series('m{h=~"x|y"}', 0, 60).count() == 2 and api.series("m", 10_000, 20_000).count() == 0
    assert {r["value"] for r in api.label_values("h", 'm{h!="x"}').collect()} == {"y", "z"}
    assert "h" in {r["label"] for r in api.label_names().collect()}
    assert api.search("m", "h").collect()[0]["values"] == ["x", "y", "z"]
    assert api.parse("sum(m)by(h)") == "sum by (h) (m)" and api.threshold("m > 3") == ("m", ">", 3.0)
    with pytest.raises(ParseError):
        api.label_names("sum(m)")


def test_render_find_pipeline(api):
    frames = api.render(["a.x", "sumSeries(a.*)"], "-5min", "now", 60, now=300)
    assert [f.count() for f in frames] == [5, 5]
    assert {r["text"] for r in api.find("a.*").collect()} == {"x", "y", "z"}
    assert api.pipeline("fetch name:m | sum", 0, 120, 60).count() == 3
    shifted = {r["step"] // (60 * SECOND): r["value"] for r in api.pipeline("fetch name:m h:x | timeshift 1min", 0, 120, 60).collect()}
    assert shifted[2] == 1.0
    assert set(WRITERS) == {"carbon", "influx", "json", "remote"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", {"k": str(i)}, "10s:2d", float(i)) for i in range(20)], "id string, labels map<string,string>, policy string, value double")
    sinks.multi(sinks.blackhole, sinks.folder(str(tmp_path / "f")), sinks.sharded(str(tmp_path / "s"), 3))(df, 7)
    sinks.folder(str(tmp_path / "f"))(df, 7)  # again: replaces itself
    assert spark.read.parquet(str(tmp_path / "f")).where("batch = 7 and policy = '10s:2d'").count() == 20
    assert spark.read.parquet(str(tmp_path / "s")).select("shard").distinct().count() <= 3
    sinks.downsample_and_write(df, sinks.folder(str(tmp_path / "r")), lambda x: x.groupBy("id").count(), sinks.folder(str(tmp_path / "g")))
    assert spark.read.parquet(str(tmp_path / "g")).collect()[0]["count"] == 20
