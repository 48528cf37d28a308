"""Every query of the core against its SQL on the smallest tables, and the driver's contract."""

import importlib
import math
import os

import pytest

import __spark_entry__ as entry
from tidewheel.operators.frames import SECOND
from tidewheel.plans import catalogue, quality_queries
from tidewheel.plans.graphite import Renderer

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings samples series metric_info unaggregated eval_items mix_targets".split()
QUERIES = quality_queries.QUERIES | catalogue.QUERIES
SQL = quality_queries.SQL | catalogue.SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return [plain(x) for x in v] if isinstance(v, list) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = importlib.import_module("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted([plain(x) for x in r] for r in cur.fetchall())
    assert sorted([plain(x) for x in r] for r in df.select(*(f"`{c}`" for c in columns)).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_products_and_powers_take_every_series(spark):
    series = Renderer(catalogue.paths(spark, SF)).render("events.*.*", catalogue.START * SECOND, (catalogue.START + catalogue.DAYS * catalogue.DAY) * SECOND, catalogue.DAY * SECOND)
    days: dict[int, list[float]] = {}
    for r in series.orderBy("name").collect():
        days.setdefault(r["step"], []).append(r["value"] * 1e-6 + 1)
    wanted = {s: (math.prod(v), (v[0] ** math.prod(v[1:]) - 1) * 1000) for s, v in days.items()}
    assert max(map(len, days.values())) > 10
    for i, name in enumerate(("g_multiply_all", "g_pow")):
        got = {r["step"]: r["value"] for r in QUERIES[name](spark, SF).collect()}
        assert set(got) == set(wanted) and all(abs(got[s] - w[i]) < 2e-6 for s, w in wanted.items())


def test_last_step_takes_in_every_event(spark):
    last = catalogue.event_rows(spark, SF).agg({"ts": "max"}).first()[0]
    assert catalogue.GRID.start + (catalogue.GRID.count - 1) * catalogue.GRID.step == catalogue.GRID.end >= last > catalogue.GRID.end - catalogue.GRID.step


def test_contract(spark):
    q, s = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(q) and set(s) <= set(q) and all(callable(f) for f in q.values())
    assert entry.entry(spark).columns == ["series", "step", "value"] and entry.entry(spark).count() > 0
