"""Formats, the index algebra, namespaces and renderers."""

import json
import math
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators.frames import SECOND, Matcher, SeriesSource, fan_out, matches
from tidewheel.operators.vectors import map_tags
from tidewheel.sources import index, ingest, namespaces, render
from tidewheel.sources.namespaces import Namespace

DAY = 86400 * SECOND


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_carbon(spark):
    df = lines(spark, "a.b.c 1.5 1700000000", "a.b 2 1700000000.5", " x  -3e2   10 ", "a..b 1 1", ".a 1 1", "a b", "a 1", "a x 1", "a 1 -1", "", "a.b. 1 5", None)
    got = {r["path"]: (r["labels"], r["ts"], r["value"]) for r in ingest.carbon(df).collect()}
    assert got == {"a.b.c": ({"__g0__": "a", "__g1__": "b", "__g2__": "c"}, 1_700_000_000 * SECOND, 1.5), "a.b": ({"__g0__": "a", "__g1__": "b"}, 1_700_000_000_500_000, 2.0), "x": ({"__g0__": "x"}, 10 * SECOND, -300.0), "a.b.": ({"__g0__": "a", "__g1__": "b"}, 5 * SECOND, 1.0)}
    assert ingest.carbon_rejected(df).count() == 6
    ruled = {r["path"]: (r["aggregation"], r["policy"]) for r in ingest.carbon_rules(ingest.carbon(df), [("^a.b.c$", "Max", "10s:2d"), ("a", "Sum", "1m:2d")]).collect()}
    assert ruled == {"a.b.c": ("Max", "10s:2d"), "a.b": ("Sum", "1m:2d"), "a.b.": ("Sum", "1m:2d"), "x": (None, None)}


def test_influx(spark):
    df = lines(spark, r'cpu,host=a\ b,dc=x=1 user=1.5,n=3i,ok=t,text="a, b=c" 1700000000123456789', "mem-free value=2", "# comment", "broken", r"m\,x,t=1 v=false,w=nan 5000")
    got = {(r["labels"]["__name__"]): (r["labels"], r["ts"], r["value"]) for r in ingest.influx(df).collect()}
    assert got["cpu_user"] == ({"__name__": "cpu_user", "host": "a b", "dc": "x=1"}, 1_700_000_000_123_456, 1.5)
    assert got["cpu_n"][2] == 3.0 and got["cpu_ok"][2] == 1.0 and "cpu_text" not in got
    assert got["mem_free_value"][1:] == (None, 2.0) and got["m_x_v"][1:] == (5, 0.0) and len(got) == 5
    assert ingest.influx(lines(spark, "m v=1 7"), precision="s").collect()[0]["ts"] == 7 * SECOND


def test_json_and_remote(spark):
    df = lines(spark, '{"tags":{"a":"b"},"timestamp":"1700000000","value":1.5}', '{"tags":{"a":"c"},"timestamp":"2024-01-01T00:00:00Z","value":2}', "{bad", '{"tags":{},"timestamp":"1","value":1}', '{"tags":{"a":"b"},"value":1}')
    assert sorted((r["labels"]["a"], r["ts"], r["value"]) for r in ingest.json_write(df).collect()) == [("b", 1_700_000_000 * SECOND, 1.5), ("c", 1_704_067_200 * SECOND, 2.0)]
    req = spark.createDataFrame([([("job", "x")], [(1000, 1.0), (2000, 2.0)])], "labels array<struct<name:string,value:string>>, samples array<struct<timestamp:bigint,value:double>>")
    rows = ingest.remote_write(req)
    assert sorted((r["labels"]["job"], r["ts"], r["value"]) for r in rows.collect()) == [("x", 1_000_000, 1.0), ("x", 2_000_000, 2.0)]
    back = ingest.remote_read(rows.withColumnRenamed("ts", "step")).collect()[0]
    assert [tuple(s) for s in back["samples"]] == [(1000, 1.0), (2000, 2.0)] and back["labels"][0]["name"] == "job"


def test_tags(spark):
    df = spark.createDataFrame([({"a": "1"},), ({"b-c": "1"},), ({"a": ""},), ({},)], "labels map<string,string>")
    assert ingest.valid_tags(df).count() == 1
    one = df.limit(1)
    assert map_tags(one, write={"x": "y"}, replace=[("a", "1", "2")]).collect()[0]["labels"] == {"a": "2", "x": "y"}
    assert map_tags(one, drop_with_value={"a": "1"}).collect()[0]["labels"] == {} and map_tags(one, drop_with_value={"a": "0"}).collect()[0]["labels"] == {"a": "1"}
    typed = spark.createDataFrame([({"__name__": "x"}, "counter"), ({"__name__": "x"}, "gauge"), ({"__g0__": "stats", "__g1__": "timers"}, None), ({"__name__": "x"}, None)], "labels map<string,string>, prom_type string")
    assert [r["kind"] for r in ingest.prom_type_route(typed).collect()] == ["counter", "gauge", "timer", "gauge"]


def holds(q, doc):
    import re

    match q:
        case index.All():
            return True
        case index.Field(n):
            return n in doc
        case index.Term(n, v):
            return doc.get(n) == v
        case index.Regexp(n, p):
            return n in doc and re.fullmatch(p, doc[n]) is not None
        case index.Negation(x):
            return not holds(x, doc)
        case index.Conjunction(ps):
            return all(holds(x, doc) for x in ps)
        case index.Disjunction(ps):
            return any(holds(x, doc) for x in ps)


def test_index_algebra_on_random_queries(spark):
    r = random.Random(1)
    docs = [{k: r.choice(["a", "ab", "b", ""]) for k in r.sample("xyz", r.randint(0, 3))} for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, labels map<string,string>")

    def query(depth):
        kind = r.randint(0, 6 if depth else 3)
        n = r.choice("xyz")
        if kind > 3:
            parts = tuple(query(depth - 1) for _ in range(r.randint(0, 3)))
            return index.Negation(query(depth - 1)) if kind == 4 else index.Conjunction(parts) if kind == 5 else index.Disjunction(parts)
        return [index.All(), index.Field(n), index.Term(n, r.choice(["a", "b", ""])), index.Regexp(n, r.choice(["a.*", "b?", ".+"]))][kind]

    qs = [query(3) for _ in range(25)]
    got = df.select("i", *(index.predicate(q).alias(f"q{j}") for j, q in enumerate(qs))).collect()
    for row in got:
        for j, q in enumerate(qs):
            assert row[f"q{j}"] == holds(q, docs[row["i"]]), q


def test_matchers_and_index_agree(spark):
    docs = [{}, {"a": ""}, {"a": "x"}, {"a": "xy"}, {"a": "z", "b": "1"}]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, labels map<string,string>")
    for op in ("=", "!=", "=~", "!~"):
        for v in ("", "x", "x.*", ".*", ".+", "x|", "x|z", "^x$"):
            m = Matcher("a", op, v)
            a = {r["i"] for r in df.where(matches(F.try_element_at("labels", F.lit("a")), m)).collect()}
            if v not in ("^x$",):
                b = {r["i"] for r in df.where(index.predicate(index.from_matchers([m]))).collect()}
                assert a == b, m


def test_namespaces(spark, tmp_path):
    ns = [Namespace("raw", 0, 2 * DAY), Namespace("fine", 60, 30 * DAY, complete=False), Namespace("coarse", 600, 60 * DAY), Namespace("year", 3600, 400 * DAY)]
    now = 1000 * DAY
    pick = lambda back: [n.name for n in namespaces.choose(ns, now - back * DAY, now)]
    assert pick(1) == ["raw"] and pick(10) == ["fine", "coarse"] and pick(50) == ["coarse"] and pick(100) == ["year"] and pick(900) == ["year"] and namespaces.choose([], 0, 1) == []
    parts = [(n.name, (now - a) // DAY, (now - b) // DAY) for n, a, b in namespaces.stitched(ns, now - 10 * DAY, now, now)]
    assert [p[0] for p in parts] == ["fine", "coarse", "raw"] and parts[-1] == ("raw", 2, 0)
    a = spark.createDataFrame([(1, 5, 1.0), (2, 5, 2.0)], "sid int, ts bigint, value double")
    b = spark.createDataFrame([(1, 6, 9.0), (3, 6, 3.0)], "sid int, ts bigint, value double")
    got = {(r["sid"], r["value"]) for r in namespaces.dedupe([(a, 60, 10), (b, 10, 5)]).collect()}
    assert got == {(1, 9.0), (2, 2.0), (3, 3.0)}
    assert {(r["sid"], r["value"]) for r in namespaces.dedupe([(a, 60, 10), (b, 10, 5)], complete=False).collect()} == {(1, 1.0), (2, 2.0), (3, 3.0)}
    dup = spark.createDataFrame([(1, 1, 5.0, 1), (1, 1, 7.0, 2), (1, 1, 5.0, 3), (1, 2, 1.0, 4)], "sid int, ts bigint, value double, seq int")
    for s, v in (("last_pushed", 5.0), ("highest", 7.0), ("lowest", 5.0), ("highest_frequency", 5.0)):
        assert {(r["ts"], r["value"]) for r in namespaces.merge_duplicates(dup, s, "seq").collect()} == {(1, v), (2, 1.0)}
    with pytest.raises(ValueError):
        namespaces.merge_duplicates(dup, "x")
    root = str(tmp_path / "ns")
    namespaces.write_namespace(spark.createDataFrame([(1, 5 * DAY, 1.0), (1, 6 * DAY, 2.0)], "sid int, ts bigint, value double"), root, ns[1])
    assert [r["value"] for r in namespaces.read_namespace(spark, root, ns[1], 6 * DAY, 7 * DAY).collect()] == [2.0]
    assert namespaces.retained(a, 1, 6).count() == 2 and namespaces.retained(a, 0, 6).count() == 0


def test_fan_out_prefers_the_first_store(spark):
    rows = lambda v: SeriesSource(spark.createDataFrame([({"a": "b"}, 1, v), ({"a": "b"}, int(v), v)], "labels map<string,string>, ts bigint, value double"))
    raw, dim = fan_out([rows(5.0), rows(6.0)], [])
    assert sorted((r["ts"], r["value"]) for r in raw.collect()) == [(1, 5.0), (5, 5.0), (6, 6.0)] and dim.count() == 1


def test_json_results(spark):
    v = spark.createDataFrame([({"a": "b"}, 2 * SECOND, 1.5), ({"a": "b"}, SECOND, math.nan), ({"a": "b"}, 1_500_000, math.inf)], "labels map<string,string>, step bigint, value double")
    m = [r["json"] for r in render.matrix_json(v).collect()]
    doc = json.loads("".join(render.response("matrix", iter(m), ["w"])))
    assert doc["data"]["result"] == [{"metric": {"a": "b"}, "values": [[1, "NaN"], [1.5, "+Inf"], [2, "1.5"]]}] and doc["warnings"] == ["w"]
    assert json.loads(render.vector_json(v.limit(1)).collect()[0]["json"])["value"] == [2, "1.5"]
    assert json.loads("".join(render.response("vector", iter([]))))["data"]["result"] == []


def test_limits(spark):
    v = spark.createDataFrame([({"a": str(i)}, 1, 1.0) for i in range(5)], "labels map<string,string>, step bigint, value double")
    some, whole = render.limited(v, 3)
    assert not whole and some.count() == 3 and render.limited(v, 5)[1]
    with pytest.raises(ValueError):
        render.limited(v, 3, require_exhaustive=True)


def test_pickle(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 120 * SECOND, 3.0)], "name string, step bigint, value double")
    assert pickle.loads(render.graphite_pickle(rows, 0, 120 * SECOND, 60 * SECOND)) == [{"name": "a", "start": 0, "end": 180, "step": 60, "values": [1.0, None, 3.0]}]


def test_lttb(spark):
    x, y = np.arange(100.0), np.zeros(100)
    y[37] = 50
    kept = render.lttb_points(x, y, 10)
    assert len(kept) == 10 and 37 in kept and kept[0] == 0 and kept[-1] == 99 and (np.diff(kept) > 0).all()
    assert render.lttb_points(x[:5], y[:5], 10).tolist() == [0, 1, 2, 3, 4]
    df = spark.createDataFrame([("s", int(i), float(v)) for i, v in zip(x, y)] + [("t", 1, 2.0), ("t", 2, None)], "name string, step bigint, value double")
    got = render.lttb(df, ["name"], "step", "value", 10)
    assert got.where("name = 's'").count() == 10 and got.where("name = 't'").count() == 1
