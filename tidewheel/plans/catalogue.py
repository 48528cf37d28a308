"""Queries of the metric engine over the test tables, one per operator, with SQL that gives the same rows.

Events serve as series ``events{event_type, user_id}`` (labels from columns) on a grid of days; samples as series with a label map; unaggregated records as
the aggregator's input. Every result is of whole tables; a trailing window or a lookback is part of the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.aggregator import pipeline as ap
from tidewheel.aggregator.rules import MappingRule, RuleSet, filter_column
from tidewheel.aggregator.types import StoragePolicy
from tidewheel.operators import temporal
from tidewheel.operators.frames import SECOND, Grid, Matcher, SeriesSource, fan_out, label_key, series_text
from tidewheel.plans.graphite import Renderer
from tidewheel.plans.pipes import Pipes
from tidewheel.plans.promql import Engine
from tidewheel.session import epoch_micros, table
from tidewheel.sources import index, ingest, namespaces, render

DAY = 86400
START = 1_704_067_200  # 2024-01-01 UTC
#: Daily steps from the first midnight to the one after the last event, so that windows that end at the steps take in every event.
DAYS = 31
GRID = Grid.seconds(START, START + (DAYS - 1) * DAY, DAY)
WEEK = 1_714_953_600  # 2024-05-06 UTC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Added to values before rounding, so that engines with different rules for halves agree.
NUDGE = 1e-10


def rounded(c: Column) -> Column:
    """Six places, without negative zero."""
    return (F.round(c + F.lit(NUDGE), 6) + F.lit(0.0)).alias("value")


def significant(c: Column) -> Column:
    """Nine significant digits, without negative zero."""
    return (F.format_string("%.8e", c * 1.000000000001).cast("double") + F.lit(0.0)).alias("value")


def significant_sql(x: str) -> str:
    return f"CAST(printf('%.8e', CAST({x} AS DOUBLE) * 1.000000000001) AS DOUBLE) + 0.0"


def shown(vector: DataFrame) -> DataFrame:
    return vector.select(series_text(F.col("labels")).alias("series"), "step", rounded(F.col("value")))


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(epoch_micros(e, "ts").alias("ts"), "value", "event_type", F.col("user_id").cast("string").alias("user_id"))


def events(spark: SparkSession, sf: str) -> SeriesSource:
    return SeriesSource(event_rows(spark, sf), {"event_type": "event_type", "user_id": "user_id"}, name="events")


def types(spark: SparkSession, sf: str) -> SeriesSource:
    """Events as one series per type, with many samples a day."""
    return SeriesSource(event_rows(spark, sf), {"event_type": "event_type"}, name="kinds")


def paths(spark: SparkSession, sf: str) -> SeriesSource:
    rows = event_rows(spark, sf).withColumn("g0", F.lit("events")).withColumn("g2", F.concat(F.lit("u"), "user_id"))
    return SeriesSource(rows, {"__g0__": "g0", "__g1__": "event_type", "__g2__": "g2"})


def stored_samples(spark: SparkSession, sf: str) -> SeriesSource:
    """Samples with the series table as dimension; a datapoint delivered twice counts with its first value."""
    s = table(spark, sf, "samples")
    rows = s.select(F.col("series_id").alias("sid"), epoch_micros(s, "timestamp").alias("ts"), "value", "sample_id").where("ts is not null and value is not null and not isnan(value)")
    once = rows.groupBy("sid", "ts").agg(F.min_by("value", "sample_id").alias("value"))
    series = table(spark, sf, "series").select(F.col("series_id").alias("sid"), F.map_concat("tags", F.create_map(F.lit("__name__"), F.col("__name__"))).alias("labels"))
    return SeriesSource(once, series=series)


# SQL building blocks
E = "e AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) AS t, value AS v FROM events)"
G = f"g AS (SELECT {START}000000 + i * {DAY}000000 AS step FROM range({DAYS}) r(i))"
V = f"{E}, {G}, v AS (SELECT event_type, user_id, step, arg_max(v, t) AS x FROM e JOIN g ON t BETWEEN step - {DAY}000000 AND step GROUP BY ALL)"
#: three days' window per type
R = f"{E}, {G}, r AS (SELECT event_type, step, t, v FROM e JOIN g ON t BETWEEN step - {3 * DAY}000000 AND step)"
#: windows with first, last and reset correction
S = f"""{R}, w AS (SELECT *, lag(v) OVER o AS p, lag(t) OVER o AS pt FROM r WINDOW o AS (PARTITION BY event_type, step ORDER BY t)),
  s AS (SELECT event_type, step, count(*) AS n, min(t) AS ft, max(t) AS lt, arg_min(v, t) AS fv, arg_max(v, t) AS lv, arg_max(p, t) AS pv, arg_max(pt, t) AS ptt,
        sum(CASE WHEN v < p THEN p ELSE 0 END) AS corr, count(CASE WHEN v < p THEN 1 END) AS resets, count(CASE WHEN v <> p THEN 1 END) AS changes FROM w GROUP BY ALL)"""
FULL = """'events{event_type="' || event_type || '",user_id="' || user_id || '"}'"""
BARE = """'{event_type="' || event_type || '",user_id="' || user_id || '"}'"""
TYPE = """'{event_type="' || event_type || '"}'"""
USER = """'{user_id="' || user_id || '"}'"""


def out(value: str, series: str, frm: str, tail: str = "") -> str:
    return f"SELECT {series} AS series, step, round(CAST({value} AS DOUBLE) + 1e-10, 6) + 0.0 AS value FROM {frm} {tail}"


def promql(name: str, text: str, sql: str | None = None, source: Callable = events, compat: str = "native", lookback: int = DAY) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        engine = Engine(source(spark, sf), lookback=lookback * SECOND, compat=compat)
        return shown(engine.query_range(text, START, START + (DAYS - 1) * DAY, DAY))

    run.__doc__ = text
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# selectors and alignment
promql("sel_eq", 'events{event_type="click"}', f"WITH {V} {out('x', FULL, 'v', "WHERE event_type = 'click'")}")
promql("sel_neq", 'events{event_type!="click"}', f"WITH {V} {out('x', FULL, 'v', "WHERE event_type <> 'click'")}")
promql("sel_re", 'events{event_type=~"c.*|view"}', f"WITH {V} {out('x', FULL, 'v', "WHERE regexp_full_match(event_type, 'c.*|view')")}")
promql("sel_nre", 'events{event_type!~"c.*|view"}', f"WITH {V} {out('x', FULL, 'v', "WHERE NOT regexp_full_match(event_type, 'c.*|view')")}")
promql("sel_missing", 'events{nosuch="",event_type=~".+"}', f"WITH {V} {out('x', FULL, 'v')}")
promql("align_lookback", "events", f"WITH {V} {out('x', FULL, 'v')}")
promql("offset", "events offset 2d", f"WITH {E}, {G}, v AS (SELECT event_type, user_id, step, arg_max(v, t) AS x FROM e JOIN g ON t BETWEEN step - {3 * DAY}000000 AND step - {2 * DAY}000000 GROUP BY ALL) {out('x', FULL, 'v')}")


def sparse_types(spark: SparkSession, sf: str) -> SeriesSource:
    """Events with a label by type and one by user of which each series has only one, the other null."""
    rows = event_rows(spark, sf)
    kind = F.when(F.col("event_type") == "click", F.concat(F.lit("u"), "user_id"))
    return SeriesSource(rows.select("ts", "value", kind.alias("clicker"), F.when(kind.isNull(), F.concat(F.lit("u"), "user_id")).alias("other")), {"clicker": "clicker", "other": "other"}, name="events")


promql("sel_null_labels", "sum_over_time(events[3d])", f"""WITH {E}, {G}, r AS (SELECT CASE WHEN event_type = 'click' THEN 'clicker' ELSE 'other' END AS label, user_id, step, v FROM e JOIN g ON t BETWEEN step - {3 * DAY}000000 AND step)
    {out('sum(v)', "'{' || label || '=\"u' || user_id || '\"}'", 'r', 'GROUP BY label, user_id, step')}""", sparse_types)
promql("time_fn", "time()", f"WITH {G} {out('step / 1e6', "'{}'", 'g')}")
promql("vector_fn", "vector(7)", f"WITH {G} {out('7.0', "'{}'", 'g')}")

# across series
for _f, _s in {"sum": "sum(x)", "min": "min(x)", "max": "max(x)", "avg": "avg(x)", "count": "CAST(count(x) AS DOUBLE)", "stddev": "stddev_pop(x)", "stdvar": "var_pop(x)", "group": "1.0"}.items():
    promql(f"agg_{_f}", f"{_f} by (event_type) (events)", f"WITH {V} {out(_s, TYPE, 'v', 'GROUP BY event_type, step')}")
promql("agg_without", "sum without (event_type) (events)", f"WITH {V} {out('sum(x)', USER, 'v', 'GROUP BY user_id, step')}")
promql("agg_quantile", "quantile by (event_type) (0.9, events)", f"WITH {V} {out('quantile_cont(x, 0.9)', TYPE, 'v', 'GROUP BY event_type, step')}")
_RANK = "k AS (SELECT *, row_number() OVER (PARTITION BY event_type, step ORDER BY x {}, user_id) AS rn FROM v)"
promql("topk", "topk by (event_type) (3, events)", f"WITH {V}, {_RANK.format('DESC')} {out('x', FULL, 'k', 'WHERE rn <= 3')}")
promql("bottomk", "bottomk by (event_type) (3, events)", f"WITH {V}, {_RANK.format('ASC')} {out('x', FULL, 'k', 'WHERE rn <= 3')}")
promql("count_values", 'count_values by (event_type) ("v", floor(events / 50))', f"""WITH {V}, c AS (SELECT event_type, step, CAST(CAST(floor(x / 50) AS BIGINT) AS VARCHAR) AS b FROM v)
    {out('CAST(count(*) AS DOUBLE)', "'{event_type=\"' || event_type || '\",v=\"' || b || '\"}'", 'c', 'GROUP BY event_type, b, step')}""")
promql("absent", 'absent(events{user_id="3",event_type="click"})', f"WITH {V} {out('1.0', "'{event_type=\"click\",user_id=\"3\"}'", 'g', "WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.step = g.step AND user_id = '3' AND event_type = 'click')")}")

# windows
for _f, _s in {
    "sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "CAST(count(v) AS DOUBLE)", "last": "arg_max(v, t)", "present": "1.0",
    "stddev": "CASE WHEN count(*) > 1 THEN stddev_pop(v) END", "stdvar": "CASE WHEN count(*) > 1 THEN var_pop(v) END",
}.items():
    promql(f"{_f}_over_time", f"{_f}_over_time(kinds[3d])", f"WITH {R} SELECT * FROM ({out(_s, TYPE if _f != 'last' else "'kinds' || " + TYPE, 'r', 'GROUP BY event_type, step')}) WHERE value IS NOT NULL", types)
promql("quantile_over_time", "quantile_over_time(0.9, kinds[3d])", f"WITH {R} {out('quantile_cont(v, 0.9)', TYPE, 'r', 'GROUP BY event_type, step')}", types)
promql("absent_over_time", 'absent_over_time(events{user_id="3",event_type="click"}[1d])', f"WITH {V} {out('1.0', "'{event_type=\"click\",user_id=\"3\"}'", 'g', "WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.step = g.step AND user_id = '3' AND event_type = 'click')")}")


def _extrapolated(counter: bool, per_second: bool) -> str:
    change = "lv - fv + corr" if counter else "lv - fv"
    zero = "CASE WHEN chg > 0 AND fv >= 0 AND cov * (fv / chg) < ts THEN cov * (fv / chg) ELSE ts END" if counter else "ts"
    return f"""WITH {S}, a AS (SELECT *, {change} AS chg, (lt - ft) / 1e6 AS cov, (ft - (step - {3 * DAY}000000)) / 1e6 AS ts, (step - lt) / 1e6 AS te FROM s WHERE n > 1),
      b AS (SELECT *, {zero} AS tz, cov / (n - 1) AS gap FROM a)
      {out(f'chg * ((cov + CASE WHEN tz < gap * 1.1 THEN tz ELSE gap / 2 END + CASE WHEN te < gap * 1.1 THEN te ELSE gap / 2 END) / cov)' + (f' / {3 * DAY}.0' if per_second else ''), TYPE, 'b')}"""


promql("rate", "rate(kinds[3d])", _extrapolated(True, True), types)
promql("increase", "increase(kinds[3d])", _extrapolated(True, False), types)
promql("delta", "delta(kinds[3d])", _extrapolated(False, False), types)
promql("irate", "irate(kinds[3d])", f"WITH {S} {out('CASE WHEN lv < pv THEN lv ELSE lv - pv END / ((lt - ptt) / 1e6)', TYPE, 's', 'WHERE n > 1')}", types)
promql("idelta", "idelta(kinds[3d])", f"WITH {S} {out('lv - pv', TYPE, 's', 'WHERE n > 1')}", types)
promql("resets", "resets(kinds[3d])", f"WITH {S} {out('CAST(resets AS DOUBLE)', TYPE, 's', 'WHERE n > 1')}", types)
promql("changes", "changes(kinds[3d])", f"WITH {S} {out('CAST(changes AS DOUBLE)', TYPE, 's', 'WHERE n > 1')}", types)
promql("deriv", "deriv(kinds[3d]) * 1000", f"WITH {R} {out('regr_slope(v, (t - step) / 1e6) * 1000', TYPE, 'r', 'GROUP BY event_type, step HAVING count(*) > 1')}", types)
promql("predict_linear", "predict_linear(kinds[3d], 3600)", f"WITH {R} {out('regr_slope(v, (t - step) / 1e6) * 3600 + regr_intercept(v, (t - step) / 1e6)', TYPE, 'r', 'GROUP BY event_type, step HAVING count(*) > 1')}", types)
promql("holt_winters", "holt_winters(kinds[3d], 0.3, 0.2)", f"""WITH RECURSIVE {R}, n AS (SELECT event_type, step, v, row_number() OVER (PARTITION BY event_type, step ORDER BY t) AS i FROM r),
    h AS (SELECT a.event_type, a.step, CAST(1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS prev, a.v AS cur, b.v - a.v AS trend FROM n a JOIN n b USING (event_type, step) WHERE a.i = 1 AND b.i = 2
          UNION ALL
          SELECT event_type, step, i, cur AS prev, 0.3 * v + (1 - 0.3) * (cur + tr) AS cur, tr AS trend
          FROM (SELECT n.event_type, n.step, n.i, n.v, h.cur, CASE WHEN h.i = 1 THEN h.trend ELSE 0.2 * (h.cur - h.prev) + (1 - 0.2) * h.trend END AS tr FROM h JOIN n ON n.event_type = h.event_type AND n.step = h.step AND n.i = h.i + 1))
    {out('arg_max(cur, i)', TYPE, 'h', 'GROUP BY event_type, step')}""", types)
promql("subquery", "max_over_time(sum_over_time(kinds[1d])[3d:1d])", f"""WITH {E}, f AS (SELECT {START}000000 + i * {DAY}000000 AS u FROM range(-3, {DAYS}) r(i)), {G},
    s AS (SELECT event_type, u, sum(v) AS x FROM e JOIN f ON t BETWEEN u - {DAY}000000 AND u GROUP BY ALL)
    {out('max(x)', TYPE, f's JOIN g ON u BETWEEN step - {3 * DAY}000000 AND step', 'GROUP BY event_type, step')}""", types)

# vector matching
A = f"{V}, a AS (SELECT event_type, step, sum(x) AS x FROM v GROUP BY ALL), b AS (SELECT event_type, step, CAST(count(x) AS DOUBLE) AS y FROM v GROUP BY ALL)"
_SUM, _N = "sum by (event_type) (events)", "count by (event_type) (events)"
for _n, _op, _s in (("add", "+", "x + y"), ("sub", "-", "x - y"), ("mul", "*", "x * y"), ("div", "/", "x / y"), ("mod", "%", "fmod(x, y)")):
    promql(f"bin_{_n}", f"{_SUM} {_op} on (event_type) {_N}", f"WITH {A} {out(_s, TYPE, 'a JOIN b USING (event_type, step)')}")
promql("bin_pow", f"({_N} / 10) ^ 2", f"WITH {A} {out('pow(y / 10, 2)', TYPE, 'b')}")
promql("bin_div_zero", "(events - events) / 0 + 1", f"WITH {V} {out("CAST('NaN' AS DOUBLE)", BARE, 'v')}")
for _n, _op in (("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<="), ("eq", "=="), ("ne", "!=")):
    _q = {"==": "=", "!=": "<>"}.get(_op, _op)
    promql(f"cmp_{_n}", f"events {_op} 50", f"WITH {V} {out('x', BARE, 'v', f'WHERE x {_q} 50')}")
promql("cmp_bool", "events > bool 50", f"WITH {V} {out('CASE WHEN x > 50 THEN 1.0 ELSE 0.0 END', BARE, 'v')}")
promql("cmp_vector", f"{_SUM} > on (event_type) {_N} * 50", f"WITH {A} {out('x', TYPE, 'a JOIN b USING (event_type, step)', 'WHERE x > y * 50')}")
promql("scalar_cmp_vector", "50 < events", f"WITH {V} {out('50.0', BARE, 'v', 'WHERE 50 < x')}")
promql("unary_minus", "-events", f"WITH {V} {out('-x', BARE, 'v')}")
promql("set_and", 'events{event_type="click"} and on (user_id) events{event_type="view"}', f"WITH {V} {out('x', FULL, 'v', "WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM v w WHERE w.event_type = 'view' AND w.user_id = v.user_id AND w.step = v.step)")}")
promql("set_unless", 'events{event_type="click"} unless on (user_id) events{event_type="view"}', f"WITH {V} {out('x', FULL, 'v', "WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM v w WHERE w.event_type = 'view' AND w.user_id = v.user_id AND w.step = v.step)")}")
promql("set_or", 'events{event_type="click"} or on (user_id) events{event_type="view"}', f"WITH {V} {out('x', FULL, 'v', "WHERE event_type = 'click' OR event_type = 'view' AND NOT EXISTS (SELECT 1 FROM v w WHERE w.event_type = 'click' AND w.user_id = v.user_id AND w.step = v.step)")}")
promql("group_left", f"events / on (event_type) group_left () {_SUM}", f"WITH {A} {out('v.x / a.x', BARE, 'v JOIN a USING (event_type, step)')}")
promql("group_right", f"{_SUM} - on (event_type) group_right () events", f"WITH {A} {out('a.x - v.x', BARE, 'v JOIN a USING (event_type, step)')}")
promql("ignoring", 'sum by (user_id, event_type) (events{event_type="click"}) / ignoring (event_type) sum by (user_id) (events)', f"""WITH {V}, u AS (SELECT user_id, step, sum(x) AS y FROM v GROUP BY ALL)
    {out('x / y', BARE, 'v JOIN u USING (user_id, step)', "WHERE event_type = 'click'")}""")

# per sample
for _n, _q, _s in (
    ("abs", "abs(events - 50)", "abs(x - 50)"), ("ceil", "ceil(events)", "ceil(x)"), ("floor", "floor(events)", "floor(x)"), ("exp", "exp(events / 100)", "exp(x / 100)"), ("sqrt", "sqrt(events)", "sqrt(x)"),
    ("ln", "ln(events)", "ln(x)"), ("log2", "log2(events)", "log2(x)"), ("log10", "log10(events)", "log10(x)"), ("sgn", "sgn(events - 50)", "CAST(sign(x - 50) AS DOUBLE)"), ("round", "round(events, 0.5)", "floor(x * 2 + 0.5) / 2"),
    ("clamp_min", "clamp_min(events, 20)", "greatest(x, 20)"), ("clamp_max", "clamp_max(events, 20)", "least(x, 20)"), ("clamp", "clamp(events, 10, 60)", "least(greatest(x, 10), 60)"), ("timestamp", "timestamp(events)", "step / 1e6"),
):
    promql(f"fn_{_n}", _q, f"WITH {V} {out(_s, BARE, 'v')}")
_T = "(TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(step / 1000000 + x * 100000) AS BIGINT)))"
for _n, _s in (("minute", f"minute{_T}"), ("hour", f"hour{_T}"), ("day_of_week", f"dayofweek{_T}"), ("day_of_month", f"day{_T}"), ("days_in_month", f"day(last_day{_T})"), ("month", f"month{_T}"), ("year", f"year{_T}")):
    promql(f"fn_{_n}", f"{_n}(events * 100000 + time())", f"WITH {V} {out(f'CAST({_s} AS DOUBLE)', BARE, 'v')}")
promql("label_join", 'label_join(events, "both", "-", "event_type", "user_id")', f"WITH {V} {out('x', "'events{both=\"' || event_type || '-' || user_id || '\",event_type=\"' || event_type || '\",user_id=\"' || user_id || '\"}'", 'v')}")
promql("label_replace", 'label_replace(events, "short", "$1_", "event_type", "^(..).*$")', f"WITH {V} {out('x', "'events{event_type=\"' || event_type || '\",short=\"' || left(event_type, 2) || '_\",user_id=\"' || user_id || '\"}'", 'v')}")


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    """histogram_quantile over daily cumulative buckets of line quantities by return flag."""
    l = table(spark, sf, "lineitem")
    day = epoch_micros(l, "l_shipdate")
    bounds = F.explode(F.array(*(F.struct(F.lit(x).alias("le"), F.lit(b).alias("b")) for x, b in (("5", 5.0), ("10", 10.0), ("20", 20.0), ("40", 40.0), ("+Inf", float("inf"))))))
    counts = l.select(day.alias("step"), "l_returnflag", "l_quantity").groupBy("step", "l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    buckets = counts.select("*", bounds.alias("x")).groupBy("step", "l_returnflag", "x.le").agg(F.sum(F.when(F.col("l_quantity") <= F.col("x.b"), F.col("n")).otherwise(0)).cast("double").alias("value"))
    from tidewheel.operators.vectors import histogram_quantile

    vector = buckets.select(F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("le"), F.col("le")).alias("labels"), "step", "value")
    return shown(histogram_quantile(vector, 0.8))


QUERIES["histogram_quantile"] = histogram
SQL["histogram_quantile"] = """
    WITH c AS (SELECT epoch_us(l_shipdate) AS step, l_returnflag AS f, count(*) FILTER (l_quantity <= 5) AS c0, count(*) FILTER (l_quantity <= 10) AS c1, count(*) FILTER (l_quantity <= 20) AS c2,
                      count(*) FILTER (l_quantity <= 40) AS c3, count(*) AS c4 FROM lineitem GROUP BY ALL)
    SELECT '{flag="' || f || '"}' AS series, step, round(1.0 * CASE WHEN c0 >= 0.8 * c4 THEN 5 * (0.8 * c4) / c0 WHEN c1 >= 0.8 * c4 THEN 5 + 5 * (0.8 * c4 - c0) / (c1 - c0) WHEN c2 >= 0.8 * c4 THEN 10 + 10 * (0.8 * c4 - c1) / (c2 - c1)
      WHEN c3 >= 0.8 * c4 THEN 20 + 20 * (0.8 * c4 - c2) / (c3 - c2) ELSE 40 END + 1e-10, 6) + 0.0 AS value FROM c"""


# stored samples with a label map
def samples_increase(spark: SparkSession, sf: str) -> DataFrame:
    """Sum by service of the increase of counters over six hours."""
    engine = Engine(stored_samples(spark, sf))
    got = engine.query_range('sum by (service) (increase({__name__=~".+_total"}[6h]))', WEEK, WEEK + 7 * DAY, 6 * 3600)
    return got.select(series_text(F.col("labels")).alias("series"), "step", significant(F.col("value")))


QUERIES["samples_increase"] = samples_increase
SQL["samples_increase"] = f"""
    WITH d AS (SELECT series_id, epoch_us("timestamp") AS t, arg_min(value, sample_id) AS v FROM samples WHERE "timestamp" IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
      c AS (SELECT d.*, s.tags['service'] AS service FROM d JOIN series s USING (series_id) WHERE ends_with(s.__name__, '_total') AND length(s.__name__) > 6),
      g AS (SELECT {WEEK}000000 + i * 21600000000 AS step FROM range(29) r(i)),
      r AS (SELECT series_id, service, step, t, v, lag(v) OVER (PARTITION BY series_id, step ORDER BY t) AS p FROM c JOIN g ON t BETWEEN step - 21600000000 AND step),
      s AS (SELECT series_id, service, step, count(*) AS n, min(t) AS ft, max(t) AS lt, arg_min(v, t) AS fv, arg_max(v, t) AS lv, sum(CASE WHEN v < p THEN p ELSE 0 END) AS corr FROM r GROUP BY ALL),
      a AS (SELECT *, lv - fv + corr AS chg, (lt - ft) / 1e6 AS cov, (ft - (step - 21600000000)) / 1e6 AS ts, (step - lt) / 1e6 AS te FROM s WHERE n > 1),
      b AS (SELECT *, CASE WHEN chg > 0 AND fv >= 0 AND cov * (fv / chg) < ts THEN cov * (fv / chg) ELSE ts END AS tz, cov / (n - 1) AS gap FROM a)
    SELECT '{{service="' || service || '"}}' AS series, step, {significant_sql("sum(chg * ((cov + CASE WHEN tz < gap * 1.1 THEN tz ELSE gap / 2 END + CASE WHEN te < gap * 1.1 THEN te ELSE gap / 2 END) / cov))")} AS value
    FROM b GROUP BY service, step"""


def samples_last(spark: SparkSession, sf: str) -> DataFrame:
    """The count of series per metric with a value in the last five minutes, hourly."""
    return shown(Engine(stored_samples(spark, sf)).query_range('count by (__name__) ({env="prod"})', WEEK, WEEK + 7 * DAY, 3600))


QUERIES["samples_instant_count"] = samples_last
SQL["samples_instant_count"] = f"""
    WITH g AS (SELECT {WEEK}000000 + i * 3600000000 AS step FROM range(169) r(i)),
      p AS (SELECT DISTINCT series_id, step FROM (SELECT series_id, epoch_us("timestamp") AS t FROM samples WHERE "timestamp" IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)) JOIN g ON t BETWEEN step - 300000000 AND step)
    SELECT s.__name__ || '{{}}' AS series, step, CAST(count(*) AS DOUBLE) AS value FROM p JOIN series s USING (series_id) WHERE s.tags['env'] = 'prod' GROUP BY s.__name__, step"""


# the label interface and the index
def _listing(name: str, run: Callable, sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


def series_dim(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "series").select("series_id", F.map_concat("tags", F.create_map(F.lit("__name__"), F.col("__name__"))).alias("labels"))


_listing("label_names", lambda s, d: stored_samples(s, d).label_names(), "SELECT DISTINCT unnest(map_keys(tags)) AS label FROM series UNION SELECT '__name__'")
_listing("label_values", lambda s, d: stored_samples(s, d).label_values("service", [Matcher("env", "=", "prod")]), "SELECT DISTINCT tags['service'] AS value FROM series WHERE tags['env'] = 'prod'")
_listing("complete_tags", lambda s, d: stored_samples(s, d).complete_tags([Matcher("env", "=", "prod")], "region|env").select("label", F.concat_ws(",", "values").alias("values")), """
    WITH x AS (SELECT unnest(map_entries(tags)) AS e FROM series WHERE tags['env'] = 'prod')
    SELECT e.key AS label, string_agg(DISTINCT e.value, ',' ORDER BY e.value) AS values FROM x WHERE e.key IN ('region', 'env') GROUP BY 1""")
_listing("index_query", lambda s, d: index.search(series_dim(s, d), (index.Term("service", "gateway") | index.Regexp("service", "b.*")) & ~index.Term("env", "prod") & index.Field("region")).select("series_id"),
         "SELECT series_id FROM series WHERE (tags['service'] = 'gateway' OR starts_with(tags['service'], 'b')) AND coalesce(tags['env'], '') <> 'prod' AND tags['region'] IS NOT NULL")
_listing("index_facets", lambda s, d: index.facets(series_dim(s, d), index.Term("env", "prod"), names=["service", "region"]),
         "WITH x AS (SELECT unnest(map_entries(tags)) AS e FROM series WHERE tags['env'] = 'prod') SELECT e.key AS label, e.value AS value, count(*) AS n_series FROM x WHERE e.key IN ('service', 'region') GROUP BY ALL")
_listing("restrict_and_strip", lambda s, d: stored_samples(s, d).restricted([Matcher("service", "=", "gateway")], ["instance"]).series_list().select(series_text(F.col("labels")).alias("series")).distinct(),
         """SELECT DISTINCT __name__ || '{env="' || tags['env'] || '",region="' || tags['region'] || '",service="' || tags['service'] || '"}' AS series FROM series WHERE tags['service'] = 'gateway'""")


def fanned_out(spark: SparkSession, sf: str) -> DataFrame:
    """Two stores that overlap read as one: clicks and views, and views again with other values."""
    rows = event_rows(spark, sf)
    columns = {"event_type": "event_type", "user_id": "user_id"}
    a = SeriesSource(rows.where("event_type in ('click', 'view')"), columns, name="events")
    b = SeriesSource(rows.where("event_type in ('view', 'error')").withColumn("value", F.col("value") + 1000), columns, name="events")
    raw, dim = fan_out([a, b], [])
    return shown(temporal.align(raw, dim, GRID, DAY * SECOND))


QUERIES["fan_out"] = fanned_out
SQL["fan_out"] = f"WITH {V} {out("CASE WHEN event_type = 'error' THEN x + 1000 ELSE x END", FULL, 'v', "WHERE event_type IN ('click', 'view', 'error')")}"


def duplicates_merged(strategy: str) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = table(spark, sf, "samples")
        rows = s.select(F.col("series_id").alias("sid"), epoch_micros(s, "timestamp").alias("ts"), "value", "sample_id").where("ts is not null and value is not null and not isnan(value)")
        return namespaces.merge_duplicates(rows, strategy, "sample_id").select("sid", "ts", "value")

    return run


for _n, _s in (("last_pushed", "arg_max(value, sample_id)"), ("highest", "max(value)"), ("lowest", "min(value)")):
    QUERIES[f"merge_{_n}"] = duplicates_merged(_n)
    SQL[f"merge_{_n}"] = f"""SELECT series_id AS sid, epoch_us("timestamp") AS ts, {_s} AS value FROM samples WHERE "timestamp" IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2"""


def downsampled(spark: SparkSession, sf: str) -> DataFrame:
    raw, _ = stored_samples(spark, sf).select([])
    return ap.tiles(raw, 3600 * SECOND, "Max")


QUERIES["tiles"] = downsampled
SQL["tiles"] = """WITH d AS (SELECT series_id, epoch_us("timestamp") AS t, arg_min(value, sample_id) AS v FROM samples WHERE "timestamp" IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY ALL)
    SELECT series_id AS sid, (t // 3600000000 + 1) * 3600000000 AS ts, max(v) AS value FROM d GROUP BY 1, 2"""


# dotted paths: daily last values of events.<type>.u<user>
P = f"{E}, {G}, p AS (SELECT 'events.' || event_type || '.u' || user_id AS name, event_type, user_id, step, arg_max(v, t) AS x FROM e JOIN g ON t >= step AND t < step + {DAY}000000 GROUP BY ALL)"
#: all days of every series, null where absent
D = f"{P}, q AS (SELECT DISTINCT name, event_type, user_id FROM p), d AS (SELECT q.name, q.event_type, q.user_id, g.step, p.x FROM q CROSS JOIN g LEFT JOIN p ON p.name = q.name AND p.step = g.step)"


def target(name: str, text: str, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = Renderer(paths(spark, sf)).render(text, START * SECOND, (START + DAYS * DAY) * SECOND, DAY * SECOND)
        return rows.select("name", "step", rounded(F.col("value")))

    run.__doc__ = text
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def named(value: str, name: str, frm: str, tail: str = "") -> str:
    return f"SELECT * FROM (SELECT {name} AS name, step, round(CAST({value} AS DOUBLE) + 1e-10, 6) + 0.0 AS value FROM {frm} {tail}) WHERE value IS NOT NULL"


target("g_fetch_glob", "events.{click,view}.u1?", f"WITH {P} {named('x', 'name', 'p', "WHERE event_type IN ('click', 'view') AND length(user_id) = 2 AND starts_with(user_id, '1')")}")
for _f, _s in (("sum", "sum(x)"), ("average", "avg(x)"), ("min", "min(x)"), ("max", "max(x)"), ("median", "median(x)"), ("stddev", "stddev_pop(x)"), ("rangeOf", "max(x) - min(x)")):
    target(f"g_{_f}", f"{_f}Series(events.*.*)", f"WITH {P} {named(_s, f"'{_f}Series'", 'p', 'GROUP BY step')}")
target("g_count", "countSeries(events.*.*)", f"WITH {P} {named('(SELECT CAST(count(DISTINCT name) AS DOUBLE) FROM p)', "'countSeries'", 'g')}")
target("g_multiply", "multiplySeries(offset(scale(events.click.*,0.000001),1))", f"WITH {P} {named('product(x * 0.000001 + 1)', "'multiplySeries'", 'p', "WHERE event_type = 'click' GROUP BY step")}")
#: all series moved near 1, so that products over them stay finite
_NEAR_1 = "offset(scale(events.*.*,0.000001),1)"
target("g_multiply_all", f"multiplySeries({_NEAR_1})", f"WITH {P} {named('product(x * 0.000001 + 1)', "'multiplySeries'", 'p', 'GROUP BY step')}")
target("g_diff", "diffSeries(events.click.*)", f"WITH {P}, f AS (SELECT min(name) AS first FROM p WHERE event_type = 'click') {named('sum(CASE WHEN name = first THEN x ELSE -x END)', "'diffSeries'", 'p, f', "WHERE event_type = 'click' GROUP BY step")}")
target("g_last", "lastSeries(events.click.*)", f"WITH {P} {named('arg_max(x, name)', "'lastSeries'", 'p', "WHERE event_type = 'click' GROUP BY step")}")
target("g_group_by_node", "groupByNode(events.*.*, 1, 'sum')", f"WITH {P} {named('sum(x)', 'event_type', 'p', 'GROUP BY event_type, step')}")
target("g_group_by_nodes", "groupByNodes(events.*.*, 'max', 0, 1)", f"WITH {P} {named('max(x)', "'events.' || event_type", 'p', 'GROUP BY event_type, step')}")
target("g_wildcards", "sumSeriesWithWildcards(events.*.*, 1)", f"WITH {P} {named('sum(x)', "'events.u' || user_id", 'p', 'GROUP BY user_id, step')}")
target("g_aggregate_wildcards", "aggregateWithWildcards(events.*.*, 'avg', 2)", f"WITH {P} {named('avg(x)', "'events.' || event_type", 'p', 'GROUP BY event_type, step')}")
target("g_percentile_of_series", "percentileOfSeries(events.*.*, 90)", f"""WITH {P}, k AS (SELECT step, list_sort(list(x)) AS l FROM p GROUP BY step)
    {named('l[least(greatest(CAST(ceil(0.9 * (len(l) + 1)) AS INT), 1), len(l))]', "'percentileOfSeries(90)'", 'k')}""")
target("g_divide", "divideSeries(events.click.*, sumSeries(events.click.*))", f"WITH {P}, s AS (SELECT step, sum(x) AS y FROM p WHERE event_type = 'click' GROUP BY step) {named('x / y', "'divideSeries(' || name || ',sumSeries)'", 'p JOIN s USING (step)', "WHERE event_type = 'click' AND y <> 0")}")
target("g_as_percent", "asPercent(events.click.*)", f"WITH {P}, s AS (SELECT step, sum(x) AS y FROM p WHERE event_type = 'click' GROUP BY step) {named('x / y * 100', "'asPercent(' || name || ')'", 'p JOIN s USING (step)', "WHERE event_type = 'click' AND y <> 0")}")
target("g_weighted_avg", "weightedAverage(events.click.*, events.view.*, 2)", f"""WITH {P}, a AS (SELECT user_id, step, x FROM p WHERE event_type = 'click'), w AS (SELECT user_id, step, x AS w FROM p WHERE event_type = 'view'),
    top AS (SELECT step, sum(x * w) AS v FROM a JOIN w USING (user_id, step) GROUP BY step), low AS (SELECT step, sum(w) AS w FROM w WHERE user_id IN (SELECT user_id FROM a) GROUP BY step)
    {named('v / w', "'weightedAverage'", 'top JOIN low USING (step)', 'WHERE w <> 0')}""")
for _n, _t, _s in (("scale", "scale(events.*.*, 2.5)", "x * 2.5"), ("offset", "offset(events.*.*, -10)", "x + -10"), ("absolute", "absolute(offset(events.*.*, -60))", "abs(x + -60)"), ("logarithm", "logarithm(events.*.*)", "CASE WHEN x > 0 THEN log10(x) END"),
                   ("square_root", "squareRoot(events.*.*)", "sqrt(x)"), ("scale_to_seconds", "scaleToSeconds(events.*.*, 60)", f"x * 60.0 / {DAY}"), ("remove_above_value", "removeAboveValue(events.*.*, 50)", "CASE WHEN x <= 50 THEN x END"), ("remove_below_value", "removeBelowValue(events.*.*, 50)", "CASE WHEN x >= 50 THEN x END")):
    target(f"g_{_n}", f"aliasByNode({_t}, 1, 2)", f"WITH {P} {named(_s, "event_type || '.u' || user_id", 'p')}")
_ALIAS = "event_type || '.u' || user_id"
_O = "WINDOW o AS (PARTITION BY name ORDER BY step)"
_BEFORE = "last_value(x IGNORE NULLS) OVER (PARTITION BY name ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_AT = "last_value(CASE WHEN x IS NOT NULL THEN step END IGNORE NULLS) OVER (PARTITION BY name ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
for _n, _t, _s in (
    ("transform_null", "transformNull(events.*.*, -1)", "coalesce(x, -1)"), ("is_non_null", "isNonNull(events.*.*)", "CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END"), ("derivative", "derivative(events.*.*)", "x - lag(x) OVER o"),
    ("non_negative_derivative", "nonNegativeDerivative(events.*.*)", "CASE WHEN x >= lag(x) OVER o THEN x - lag(x) OVER o END"), ("integral", "integral(events.*.*)", "CASE WHEN x IS NOT NULL THEN sum(x) OVER o END"),
    ("per_second", "scale(perSecond(events.*.*), 1000)", f"CASE WHEN x >= {_BEFORE} THEN (x - {_BEFORE}) / ((step - {_AT}) / 1e6) * 1000 END"), ("changed", "changed(events.*.*)", f"CASE WHEN x <> {_BEFORE} THEN 1.0 ELSE 0.0 END"),
    ("stdev", "stdev(events.*.*, 5, 0.5)", "CASE WHEN count(x) OVER f / 5.0 >= 0.5 THEN stddev_pop(x) OVER f END"), ("moving_average", "movingAverage(events.*.*, 5)", "avg(x) OVER m"), ("moving_max", "movingMax(events.*.*, '5d')", "max(x) OVER m"),
    ("keep_last_value", "keepLastValue(events.*.*, 2)", f"coalesce(x, CASE WHEN step - {_AT} <= {2 * DAY}000000 THEN {_BEFORE} END)"), ("delay", "delay(events.*.*, 3)", "lag(x, 3) OVER o"),
):
    target(f"g_{_n}", f"aliasByNode({_t}, 1, 2)", f"WITH {D} SELECT * FROM (SELECT {_ALIAS} AS name, step, round(CAST({_s} AS DOUBLE) + 1e-10, 6) + 0.0 AS value FROM d {_O}, f AS (PARTITION BY name ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), m AS (PARTITION BY name ORDER BY step ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE value IS NOT NULL")
target("g_summarize", "aliasByNode(summarize(events.*.*, '1w', 'avg'), 1, 2)", f"WITH {P} SELECT {_ALIAS} AS name, step // {7 * DAY}000000 * {7 * DAY}000000 AS step, round(avg(x) + 1e-10, 6) + 0.0 AS value FROM p GROUP BY 1, 2")
target("g_smart_summarize", "aliasByNode(smartSummarize(events.*.*, '5d', 'max'), 1, 2)", f"WITH {P} SELECT {_ALIAS} AS name, (step - {START}000000) // {5 * DAY}000000 * {5 * DAY}000000 + {START}000000 AS step, round(max(x) + 1e-10, 6) + 0.0 AS value FROM p GROUP BY 1, 2")
target("g_n_percentile", "aliasByNode(nPercentile(events.*.*, 80), 1, 2)", f"""WITH {P}, k AS (SELECT event_type, user_id, list_sort(list(x)) AS l FROM p GROUP BY ALL)
    {named('l[least(greatest(CAST(ceil(0.8 * (len(l) + 1)) AS INT), 1), len(l))]', _ALIAS, 'k CROSS JOIN g')}""")
target("g_remove_above_percentile", "aliasByNode(removeAbovePercentile(events.*.*, 80), 1, 2)", f"""WITH {P}, k AS (SELECT name, list_sort(list(x)) AS l FROM p GROUP BY ALL)
    {named('x', _ALIAS, 'p JOIN k USING (name)', 'WHERE x <= l[least(greatest(CAST(ceil(0.8 * (len(l) + 1)) AS INT), 1), len(l))]')}""")
target("g_remove_empty", "aliasByNode(removeEmptySeries(events.*.*, 0.4), 1, 2)", f"WITH {P} {named('x', _ALIAS, 'p', f'WHERE name IN (SELECT name FROM p GROUP BY name HAVING count(x) / {DAYS}.0 >= 0.4)')}")
target("g_filter_series", "aliasByNode(filterSeries(events.*.*, 'max', '>', 120), 1, 2)", f"WITH {P} {named('x', _ALIAS, 'p', 'WHERE name IN (SELECT name FROM p GROUP BY name HAVING max(x) > 120)')}")
target("g_highest", "aliasByNode(highest(events.*.*, 7, 'max'), 1, 2)", f"WITH {P} {named('x', _ALIAS, 'p', 'WHERE name IN (SELECT name FROM p GROUP BY name ORDER BY max(x) DESC, name LIMIT 7)')}")
target("g_lowest", "aliasByNode(lowest(events.*.*, 7, 'sum'), 1, 2)", f"WITH {P} {named('x', _ALIAS, 'p', 'WHERE name IN (SELECT name FROM p GROUP BY name ORDER BY round(sum(x), 9), name LIMIT 7)')}")
target("g_limit", "limit(events.*.*, 5)", f"WITH {P} {named('x', 'name', 'p', 'WHERE name IN (SELECT DISTINCT name FROM p ORDER BY name LIMIT 5)')}")
target("g_exclude", "exclude(events.*.*, 'click|u1')", f"WITH {P} {named('x', 'name', 'p', "WHERE NOT regexp_matches(name, 'click|u1')")}")
target("g_alias_sub", "aliasSub(events.click.*, 'events.(\\w+)', 'kind-\\1')", f"WITH {P} {named('x', "'kind-click.u' || user_id", 'p', "WHERE event_type = 'click'")}")
target("g_alias_by_metric", "aliasByMetric(events.click.*)", f"WITH {P} {named('x', "'u' || user_id", 'p', "WHERE event_type = 'click'")}")
target("g_time_shift", "aliasByNode(timeShift(events.*.*, '2d'), 1, 2)", f"WITH {E}, {G}, p AS (SELECT event_type, user_id, step, arg_max(v, t) AS x FROM e JOIN g ON t >= step - {2 * DAY}000000 AND t < step - {DAY}000000 GROUP BY ALL) {named('x', _ALIAS, 'p')}")
target("g_constant_line", "constantLine(42)", f"WITH {G} {named('42.0', "'42'", 'g')}")
target("g_identity", "identity('clock')", f"WITH {G} {named('step / 1e6', "'clock'", 'g')}")
target("g_apply_by_node", "applyByNode(events.*.*, 1, 'sumSeries(%.*)', '%.total')", f"WITH {P} {named('sum(x)', "'events.' || event_type || '.total'", 'p', 'GROUP BY event_type, step')}")
target("g_sustained_above", "aliasByNode(sustainedAbove(groupByNode(events.*.*, 1, 'max'), 150, '2d'), 0)", f"""WITH {P}, m AS (SELECT event_type, step, max(x) AS x FROM p GROUP BY ALL),
    q AS (SELECT event_type, step, x, step - row_number() OVER (PARTITION BY event_type ORDER BY step) * {DAY}000000 AS isle FROM m WHERE x >= 150), n AS (SELECT *, count(*) OVER (PARTITION BY event_type, isle) AS c FROM q)
    {named('x', 'event_type', 'n', 'WHERE c >= 2')}""")
target("g_pow", f"alias(scale(offset(powSeries({_NEAR_1}),-1),1000),'pow')", f"WITH {P}, y AS (SELECT name, step, x * 0.000001 + 1 AS y FROM p), k AS (SELECT step, arg_min(y, name) AS first, product(y) AS whole FROM y GROUP BY step) {named('(pow(first, whole / first) - 1) * 1000', "'pow'", 'k')}")
_AFTER = "first_value(x IGNORE NULLS) OVER (PARTITION BY name ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
_THEN = _AFTER.replace("first_value(x ", "first_value(CASE WHEN x IS NOT NULL THEN step END ")
target("g_interpolate", "aliasByNode(interpolate(events.*.*), 1, 2)", f"""WITH {D}, i AS (SELECT *, {_BEFORE} AS bx, {_AT} AS bt, {_AFTER} AS ax, {_THEN} AS nt FROM d)
    {named('coalesce(x, bx + (ax - bx) * (step - bt) / (nt - bt))', _ALIAS, 'i')}""")
target("g_moving_median", "aliasByNode(movingMedian(events.*.*, 5), 1, 2)", f"WITH {D} SELECT * FROM (SELECT {_ALIAS} AS name, step, round(median(x) OVER (PARTITION BY name ORDER BY step ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) + 1e-10, 6) + 0.0 AS value FROM d) WHERE value IS NOT NULL")
target("g_ema", "aliasByNode(exponentialMovingAverage(events.*.*, 5), 1, 2)", f"""WITH RECURSIVE {D}, m AS (SELECT event_type, user_id, name, step, x FROM d WHERE step = {START}000000
      UNION ALL SELECT d.event_type, d.user_id, d.name, d.step, coalesce(2.0 / 6 * d.x + (1 - 2.0 / 6) * m.x, d.x, m.x) FROM m JOIN d ON d.name = m.name AND d.step = m.step + {DAY}000000)
    {named('x', _ALIAS, 'm')}""")
QUERIES["g_find"] = lambda spark, sf: Renderer(paths(spark, sf)).find("events.*")
SQL["g_find"] = "SELECT DISTINCT 'events.' || event_type AS path, event_type AS text, FALSE AS leaf FROM events"


# the pipeline language
def pipe(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return shown(Pipes(events(spark, sf), lookback=DAY * SECOND).query(text, START, START + (DAYS - 1) * DAY, DAY))

    run.__doc__ = text
    QUERIES[name], SQL[name] = run, sql


pipe("pipe_sum", "fetch name:events event_type:{click,view} | sum event_type | scale 2", f"WITH {V} {out('sum(x) * 2', TYPE, 'v', "WHERE event_type IN ('click', 'view') GROUP BY event_type, step")}")
pipe("pipe_filter", "fetch name:events event_type:!click | > 100", f"WITH {V} {out('x', FULL, 'v', "WHERE event_type <> 'click' AND x > 100")}")
pipe("pipe_macro", "clicks = fetch name:events event_type:click; clicks | setDiff (fetch name:events event_type:view) user_id", f"WITH {V} {out('x', FULL, 'v', "WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM v w WHERE w.event_type = 'view' AND w.user_id = v.user_id AND w.step = v.step)")}")
pipe("pipe_percent", "fetch name:events event_type:click | asPercent", f"WITH {V}, s AS (SELECT step, sum(x) AS y FROM v WHERE event_type = 'click' GROUP BY step) {out('x / y * 100', BARE, 'v JOIN s USING (step)', "WHERE event_type = 'click'")}")
pipe("pipe_exclude", "fetch name:events | excludeByTag event_type c* | max event_type", f"WITH {V} {out('max(x)', TYPE, 'v', "WHERE NOT starts_with(event_type, 'c') GROUP BY event_type, step")}")
pipe("pipe_transform_null", "fetch name:events event_type:click | sum event_type | transformNull 0 | integral", f"WITH {V}, s AS (SELECT event_type, step, sum(x) AS x FROM v WHERE event_type = 'click' GROUP BY ALL) {out('sum(coalesce(x, 0)) OVER (ORDER BY g.step)', "'{event_type=\"click\"}'", '(SELECT g.step, s.x FROM g LEFT JOIN s USING (step)) g')}")
#: all days of every series, null where absent
_DENSE = f"{V}, q AS (SELECT DISTINCT event_type, user_id FROM v), d AS (SELECT q.event_type, q.user_id, q.event_type || '/' || q.user_id AS name, g.step, v.x FROM q CROSS JOIN g LEFT JOIN v ON v.event_type = q.event_type AND v.user_id = q.user_id AND v.step = g.step)"
_CLICK = "WHERE event_type = 'click'"
for _n, _t, _s in (("abs", "offset -60 | abs", "abs(x - 60)"), ("sqrt", "sqrt", "sqrt(x)"), ("remove_above_value", "removeAboveValue 50", "CASE WHEN x <= 50 THEN x END"), ("remove_below_value", "removeBelowValue 50", "CASE WHEN x >= 50 THEN x END"),
                   ("scale_to_seconds", "scaleToSeconds 60", f"x * 60.0 / {DAY}"), ("timestamp", "timestamp", "step / 1e6"), ("logarithm", "offset 1 | logarithm", "log10(x + 1)")):
    pipe(f"pipe_{_n}", f"fetch name:events | {_t}", f"WITH {V} SELECT * FROM ({out(_s, FULL, 'v')}) WHERE value IS NOT NULL")
for _n, _op in (("ge", ">="), ("le", "<="), ("lt", "<"), ("eq", "=="), ("ne", "!=")):
    pipe(f"pipe_{_n}", f"fetch name:events | {_n} 50", f"WITH {V} {out('x', FULL, 'v', f'WHERE x {({"==": "=", "!=": "<>"}).get(_op, _op)} 50')}")
for _n, _s in (("avg", "avg(x)"), ("min", "min(x)"), ("count", "CAST(count(x) AS DOUBLE)"), ("range", "max(x) - min(x)")):
    pipe(f"pipe_{_n}", f"fetch name:events | {_n} event_type", f"WITH {V} {out(_s, TYPE, 'v', 'GROUP BY event_type, step')}")
pipe("pipe_multiply", "fetch name:events | scale 0.000001 | offset 1 | multiply event_type", f"WITH {V} {out('product(x * 0.000001 + 1)', TYPE, 'v', 'GROUP BY event_type, step')}")
pipe("pipe_diff", "fetch name:events | diff event_type", f"WITH {V}, f AS (SELECT event_type, min(user_id) AS first FROM v GROUP BY event_type) {out('sum(CASE WHEN user_id = first THEN x ELSE -x END)', TYPE, 'v JOIN f USING (event_type)', 'GROUP BY event_type, step')}")
pipe("pipe_alias", "fetch name:events event_type:click | sum user_id | alias clicks", f"WITH {V} {out('sum(x)', "'clicks{user_id=\"' || user_id || '\"}'", 'v', f'{_CLICK} GROUP BY user_id, step')}")
pipe("pipe_alias_by_tags", "fetch name:events | aliasByTags event_type user_id", f"WITH {V} {out('x', "event_type || ' ' || user_id || " + BARE, 'v')}")
pipe("pipe_show_tags", "fetch name:events | sum event_type | showTags true event_type", f"""WITH {V} {out('sum(x)', """'{"event_type":"' || event_type || '"}' || """ + TYPE, 'v', 'GROUP BY event_type, step')}""")
pipe("pipe_execute", "fetch name:events event_type:click | execute (fetch name:events event_type:view)", f"WITH {V} {out('x', FULL, 'v', "WHERE event_type = 'view'")}")
pipe("pipe_fallback", "fetch name:events event_type:nosuch | fallbackSeries 7", f"WITH {G} {out('7.0', "'{}'", 'g')}")
pipe("pipe_constant_line", "constantLine 42", f"WITH {G} {out('42.0', "'{}'", 'g')}")
pipe("pipe_identity", "identity clock", f"WITH {G} {out('step / 1e6', "'{}'", 'g')}")
for _n, _o in (("head", "ASC"), ("tail", "DESC")):
    pipe(f"pipe_{_n}", f"fetch name:events | {_n} 5", f"WITH {V}, k AS (SELECT DISTINCT event_type, user_id FROM v ORDER BY event_type {_o}, user_id {_o} LIMIT 5) {out('x', FULL, 'v JOIN k USING (event_type, user_id)')}")
pipe("pipe_sort", "fetch name:events | sort max asc", f"WITH {V} {out('x', FULL, 'v')}")
pipe("pipe_intersect", "fetch name:events event_type:click | intersect (fetch name:events event_type:view) user_id", f"WITH {V} {out('x', FULL, 'v', "WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM v w WHERE w.event_type = 'view' AND w.user_id = v.user_id AND w.step = v.step)")}")
pipe("pipe_divide", "fetch name:events event_type:click | divideSeries (fetch name:events event_type:view) user_id", f"WITH {V}, w AS (SELECT user_id, step, x AS y FROM v WHERE event_type = 'view') {out('x / y', BARE, 'v JOIN w USING (user_id, step)', _CLICK)}")
pipe("pipe_percentile_of_series", "fetch name:events | percentileOfSeries 90 false event_type", f"WITH {V}, k AS (SELECT event_type, step, list_sort(list(x)) AS l FROM v GROUP BY ALL) {out('l[least(greatest(CAST(ceil(0.9 * (len(l) + 1)) AS INT), 1), len(l))]', TYPE, 'k')}")
pipe("pipe_timeshift", "fetch name:events | timeshift 2d", SQL["offset"])
for _n, _t, _s in (
    ("changed", "changed", f"CASE WHEN x <> {_BEFORE} THEN 1.0 ELSE 0.0 END"), ("derivative", "derivative", "x - lag(x) OVER o"), ("integral", "integral", "CASE WHEN x IS NOT NULL THEN sum(x) OVER o END"), ("is_non_null", "isNonNull", "CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END"),
    ("non_negative_derivative", "nonNegativeDerivative", "CASE WHEN x >= lag(x) OVER o THEN x - lag(x) OVER o END"), ("keep_last_value", "keepLastValue 2", f"coalesce(x, CASE WHEN step - {_AT} <= {2 * DAY}000000 THEN {_BEFORE} END)"),
    ("per_second", "perSecond | scale 1000", f"CASE WHEN x >= {_BEFORE} THEN (x - {_BEFORE}) / ((step - {_AT}) / 1e6) * 1000 END"), ("stdev", "stdev 5 0.5", "CASE WHEN count(x) OVER f / 5.0 >= 0.5 THEN stddev_pop(x) OVER f END"),
    ("moving", "moving 5 avg", "avg(x) OVER m"), ("sustain", "sustain 3d", "CASE WHEN count(x) OVER t = 3 THEN min(x) OVER t END"),
):
    pipe(f"pipe_{_n}", f"fetch name:events | {_t}", f"""WITH {_DENSE} SELECT * FROM (SELECT {FULL} AS series, step, round(CAST({_s} AS DOUBLE) + 1e-10, 6) + 0.0 AS value FROM d {_O}, f AS (PARTITION BY name ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
        m AS (PARTITION BY name ORDER BY step ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), t AS (PARTITION BY name ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE value IS NOT NULL""")
_RANKED = f"{V}, k AS (SELECT event_type, user_id, list_sort(list(x)) AS l FROM v GROUP BY ALL)"
_P80 = "l[least(greatest(CAST(ceil(0.8 * (len(l) + 1)) AS INT), 1), len(l))]"
pipe("pipe_n_percentile", "fetch name:events | nPercentile 80", f"WITH {_RANKED} {out(_P80, FULL, 'k CROSS JOIN g')}")
for _n, _t, _op in (("above", "Above", "<="), ("below", "Below", ">=")):
    pipe(f"pipe_remove_{_n}_percentile", f"fetch name:events | remove{_t}Percentile 80", f"WITH {_RANKED} {out('x', FULL, 'v JOIN k USING (event_type, user_id)', f'WHERE x {_op} {_P80}')}")
    pipe(f"pipe_sustained_{_n}", f"fetch name:events | max event_type | sustained{_t} 150 2d", f"""WITH {V}, m AS (SELECT event_type, step, max(x) AS x FROM v GROUP BY ALL),
        q AS (SELECT event_type, step, x, step - row_number() OVER (PARTITION BY event_type ORDER BY step) * {DAY}000000 AS isle FROM m WHERE x {'>=' if _n == 'above' else '<='} 150), n AS (SELECT *, count(*) OVER (PARTITION BY event_type, isle) AS c FROM q)
        {out('x', TYPE, 'n', 'WHERE c >= 2')}""")
pipe("pipe_remove_empty", "fetch name:events | removeEmpty 0.4", f"WITH {V}, k AS (SELECT event_type, user_id FROM v GROUP BY ALL HAVING count(x) / {DAYS}.0 >= 0.4) {out('x', FULL, 'v JOIN k USING (event_type, user_id)')}")
pipe("pipe_summarize", "fetch name:events | summarize 1w avg", f"WITH {V} SELECT {FULL} AS series, step // {7 * DAY}000000 * {7 * DAY}000000 AS step, round(avg(x) + 1e-10, 6) + 0.0 AS value FROM v GROUP BY 1, 2")


# the aggregator
HOUR = 3600 * SECOND


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Client records as the aggregator's input: one row per value, nulls without tags given no labels."""
    u = table(spark, sf, "unaggregated")
    name = F.coalesce(F.col("__name__"), F.split_part("id", F.lit("+"), F.lit(1)))
    rows = u.select(name.alias("id"), F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("labels"), "type", epoch_micros(u, "timestamp").alias("ts"), epoch_micros(u, "received_at").alias("arrived"), "record_id", "counter_val", "batch_timer", "gauge_val").where("ts is not null")
    return ap.values_of(rows)


def by_app(rows: DataFrame) -> DataFrame:
    """Labels reduced to the app, as the aggregated metrics are kept."""
    return rows.withColumn("labels", F.map_filter("labels", lambda k, _: k == "app"))


def aggregated(kind: str, tys: list[str], exact: bool = True) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        points = ap.windowed(by_app(records(spark, sf)).where(F.col("kind") == kind), HOUR, tys, exact)
        return points.select("id", F.try_element_at("labels", F.lit("app")).alias("app"), "agg", "ts", significant(F.col("value")))

    return run


U = """u AS (SELECT coalesce(__name__, split_part(id, '+', 1)) AS id, tags['app'] AS app, tags, type, (epoch_us("timestamp") // 3600000000 + 1) * 3600000000 AS ts, epoch_us("timestamp") AS t, epoch_us(received_at) AS ta, counter_val, batch_timer, gauge_val
      FROM unaggregated WHERE "timestamp" IS NOT NULL)"""
_ROWS = {"counter": "SELECT id, app, tags, ts, t, CAST(counter_val AS DOUBLE) AS v FROM u WHERE type = 'counter' AND counter_val IS NOT NULL", "gauge": "SELECT id, app, tags, ts, t, gauge_val AS v FROM u WHERE type = 'gauge' AND gauge_val IS NOT NULL", "timer": "SELECT id, app, tags, ts, t, unnest(batch_timer) AS v FROM u WHERE type = 'timer'"}
_AGG = {"Sum": "coalesce(sum(w), 0)", "SumSq": "coalesce(sum(w * w), 0)", "Count": "CAST(count(*) AS DOUBLE)", "Mean": "coalesce(avg(w), 0)", "Min": "min(w)", "Max": "max(w)", "Stdev": "coalesce(stddev_samp(w), 0)", "Median": "median(w)", "P99": "quantile_cont(w, 0.99)"}


def _aggregated_sql(kind: str, tys: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT id, app, '{t}' AS agg, ts, {significant_sql(_AGG[t])} AS value FROM x GROUP BY id, app, ts" for t in tys)
    return f"WITH {U}, x AS (SELECT *, CASE WHEN isnan(v) THEN NULL ELSE v END AS w FROM ({_ROWS[kind]})) SELECT * FROM ({parts}) WHERE value IS NOT NULL"


for _k, _t in (("counter", ["Sum", "Count", "Min", "Max", "Mean", "Stdev"]), ("gauge", ["Min", "Max", "Mean", "Count"]), ("timer", ["Sum", "Mean", "Min", "Max", "Count", "Median", "P99"])):
    QUERIES[f"aggr_{_k}"] = aggregated(_k, _t)
    SQL[f"aggr_{_k}"] = _aggregated_sql(_k, _t)


def gauge_last(spark: SparkSession, sf: str) -> DataFrame:
    """The default of gauges: the last value by event time, of equal times the greatest."""
    rows = by_app(records(spark, sf)).where("kind = 'gauge' and not isnan(value)")
    once = rows.groupBy("id", "labels", "kind", "ts").agg(F.max("value").alias("value"))
    points = ap.windowed(once, HOUR, ["Last"])
    return points.select("id", F.try_element_at("labels", F.lit("app")).alias("app"), "ts", "value")


QUERIES["aggr_gauge_last"] = gauge_last
SQL["aggr_gauge_last"] = f"WITH {U}, x AS (SELECT id, app, ts, t, max(v) AS v FROM ({_ROWS['gauge']}) WHERE NOT isnan(v) GROUP BY ALL) SELECT id, app, ts, arg_max(v, t) AS value FROM x GROUP BY 1, 2, 3"
QUERIES["aggr_timer_approx"] = lambda spark, sf: aggregated("timer", ["P50", "P95", "P99"], exact=False)(spark, sf)


def transform(name: str) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        points = ap.run(by_app(records(spark, sf)).where("kind = 'counter'"), ap.Pipeline([ap.Aggregate(("Sum",)), ap.Transform(name)]), HOUR)
        return points.select("id", F.try_element_at("labels", F.lit("app")).alias("app"), "ts", significant(F.col("value")))

    return run


_W = f"WITH {U}, s AS (SELECT id, app, ts, sum(v) AS v FROM ({_ROWS['counter']}) GROUP BY ALL), l AS (SELECT *, lag(v) OVER o AS p, lag(ts) OVER o AS pt, sum(v) OVER o AS run FROM s WINDOW o AS (PARTITION BY id, app ORDER BY ts))"
for _n, _s in (("Absolute", "SELECT id, app, ts, " + significant_sql("abs(v)") + " AS value FROM l"), ("Add", "SELECT id, app, ts, " + significant_sql("run") + " AS value FROM l"), ("PerSecond", "SELECT id, app, ts, " + significant_sql("(v - p) * 1e6 / (ts - pt)") + " AS value FROM l WHERE v >= p"),
               ("Increase", "SELECT id, app, ts, " + significant_sql("v - coalesce(p, 0)") + " AS value FROM l WHERE v >= coalesce(p, 0)"), ("Reset", "SELECT id, app, ts, " + significant_sql("v") + " AS value FROM l UNION ALL SELECT id, app, ts + 1800000000, 0.0 FROM l")):
    QUERIES[f"tf_{_n.lower()}"] = transform(_n)
    SQL[f"tf_{_n.lower()}"] = f"{_W} {_s}"


def rollup(exclude: bool) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        r = ap.Rollup("rolled_{{ .MetricName }}", ("client", "region") if exclude else ("app", "region"), exclude, ("Sum", "Max"))
        points = ap.run(records(spark, sf).where("kind = 'counter'"), ap.Pipeline([ap.Aggregate(("Sum",)), r]), HOUR)
        return points.select("id", series_text(F.map_filter("labels", lambda k, _: k != "__rollup__")).alias("labels"), "agg", "ts", significant(F.col("value")))

    return run


QUERIES["rollup_groupby"], QUERIES["rollup_exclude"] = rollup(False), rollup(True)
_RU = f"""WITH {U}, s AS (SELECT id, map_from_entries(list_sort(map_entries(coalesce(tags, MAP {{}})))) AS tags, ts, sum(v) AS v FROM ({_ROWS['counter']}) GROUP BY ALL)"""
SQL["rollup_groupby"] = f"""{_RU}, x AS (SELECT 'rolled_' || id AS id, '{{app="' || tags['app'] || '",region="' || tags['region'] || '"}}' AS labels, ts, v FROM s WHERE tags['app'] IS NOT NULL AND tags['region'] IS NOT NULL)
    SELECT id, labels, 'Sum' AS agg, ts, {significant_sql("sum(v)")} AS value FROM x GROUP BY ALL UNION ALL SELECT id, labels, 'Max' AS agg, ts, {significant_sql("max(v)")} AS value FROM x GROUP BY ALL"""
SQL["rollup_exclude"] = f"""{_RU}, x AS (SELECT 'rolled_' || id AS id, CASE WHEN tags['app'] IS NULL THEN '{{}}' ELSE '{{app="' || tags['app'] || '"}}' END AS labels, ts, v FROM s)
    SELECT id, labels, 'Sum' AS agg, ts, {significant_sql("sum(v)")} AS value FROM x GROUP BY ALL UNION ALL SELECT id, labels, 'Max' AS agg, ts, {significant_sql("max(v)")} AS value FROM x GROUP BY ALL"""

RULES = RuleSet([
    MappingRule("kiosk", "app:kiosk name:*_*", [StoragePolicy.parse("10s:2d")], ("Sum",)),
    MappingRule("mobile", "app:{handset,tvbox} region:!vast", [StoragePolicy.parse("1m:40d"), StoragePolicy.parse("10s:2d")]),
    MappingRule("probes", "app:probe", drop="must"),
    MappingRule("batch", "app:batch*", drop="if-only-match"),
])


def mapped(spark: SparkSession, sf: str) -> DataFrame:
    """Which storage policies each record's metric gets, and which are dropped."""
    got = RULES.matched(records(spark, sf), 0)
    return got.groupBy("id", F.concat_ws(",", F.array_sort("policies")).alias("policies"), "dropped").agg(F.count(F.lit(1)).alias("n"))


QUERIES["drop_policies"] = mapped
SQL["drop_policies"] = f"""WITH {U}, r AS ({_ROWS['counter']} UNION ALL {_ROWS['gauge']} UNION ALL {_ROWS['timer']}),
    m AS (SELECT id, app, coalesce(app = 'kiosk' AND contains(id, '_'), FALSE) AS a, coalesce(app IN ('handset', 'tvbox'), FALSE) AND coalesce(tags['region'], '') <> 'vast' AS b FROM r WHERE v IS NOT NULL)
    SELECT id, CASE WHEN b THEN '10s:2d,1m:40d' WHEN a THEN '10s:2d' ELSE '1m:2d' END AS policies, coalesce(app = 'probe', FALSE) OR (coalesce(starts_with(app, 'batch'), FALSE) AND NOT a AND NOT b) AS dropped, count(*) AS n FROM m GROUP BY ALL"""


def filtered(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).where(filter_column("name:{request,upload}_time app:!kiosk region:ost-?")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


QUERIES["rule_filter"] = filtered
SQL["rule_filter"] = f"WITH {U}, r AS ({_ROWS['timer']}) SELECT id, count(*) AS n FROM r WHERE id IN ('request_time', 'upload_time') AND coalesce(app, '') <> 'kiosk' AND regexp_full_match(tags['region'], 'ost-.') AND v IS NOT NULL GROUP BY id"


def in_time(spark: SparkSession, sf: str) -> DataFrame:
    kept = ap.timely(records(spark, sf), "arrived", 600 * SECOND, 60 * SECOND)
    return kept.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


QUERIES["late_rejected"] = in_time
SQL["late_rejected"] = f"WITH {U}, r AS (SELECT id, CASE type WHEN 'timer' THEN len(list_filter(batch_timer, lambda z: z IS NOT NULL)) WHEN 'gauge' THEN CAST(gauge_val IS NOT NULL AS INT) ELSE CAST(counter_val IS NOT NULL AS INT) END AS k FROM u WHERE ta - t BETWEEN -60000000 AND 600000000) SELECT id, CAST(sum(k) AS BIGINT) AS n FROM r WHERE k > 0 GROUP BY id"


# formats
def carbon_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as plaintext lines and parsed again, with some broken lines between."""
    e = event_rows(spark, sf)
    at = F.floor(F.col("ts") / SECOND).cast("string")
    lines = e.select(F.concat_ws(" ", F.concat(F.lit("events."), "event_type", F.lit(".u"), "user_id"), F.col("value").cast("string"), at).alias("value"))
    broken = e.select(F.concat(F.lit("events.."), "event_type", F.lit(" x "), at).alias("value"))
    got = ingest.carbon(lines.unionByName(broken))
    return got.groupBy(F.try_element_at("labels", F.lit("__g1__")).alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"), F.bit_xor("ts").alias("times"))


QUERIES["carbon_lines"] = carbon_roundtrip
SQL["carbon_lines"] = "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, bit_xor(epoch_us(ts) // 1000000 * 1000000) AS times FROM events GROUP BY 1"


def influx_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    e = event_rows(spark, sf)
    line = F.concat(F.lit("events,type="), "event_type", F.lit(",user=u\\ "), "user_id", F.lit(" value="), F.col("value").cast("string"), F.lit(',n=3i,ok=true,note="a b,c" '), (F.col("ts") * 1000).cast("string"))
    got = ingest.influx(e.select(line.alias("value")))
    return got.groupBy(F.try_element_at("labels", F.lit("__name__")).alias("name"), F.try_element_at("labels", F.lit("type")).alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"), F.bit_xor("ts").alias("times"))


QUERIES["influx_lines"] = influx_roundtrip
SQL["influx_lines"] = """WITH e AS (SELECT event_type, unnest([{'n': 'events_value', 'v': value}, {'n': 'events_n', 'v': 3.0}, {'n': 'events_ok', 'v': 1.0}]) AS f, epoch_us(ts) AS t FROM events)
    SELECT f.n AS name, event_type, count(*) AS n, round(sum(f.v), 3) AS total, bit_xor(t) AS times FROM e GROUP BY 1, 2"""


def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    e = event_rows(spark, sf)
    line = F.to_json(F.struct(F.create_map(F.lit("type"), F.col("event_type")).alias("tags"), F.floor(F.col("ts") / SECOND).cast("string").alias("timestamp"), "value"))
    got = ingest.json_write(e.select(line.alias("value")))
    return got.groupBy(F.try_element_at("labels", F.lit("type")).alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"), F.bit_xor("ts").alias("times"))


QUERIES["json_lines"] = json_roundtrip
SQL["json_lines"] = SQL["carbon_lines"]


def lttb_view(spark: SparkSession, sf: str) -> DataFrame:
    """Down-sampling for display: 20 of the 31 points of each event type."""
    x = Engine(types(spark, sf), lookback=DAY * SECOND).query_range("sum_over_time(kinds[1d])", START, START + (DAYS - 1) * DAY, DAY)
    return render.lttb(shown(x), ["series"], "step", "value", 20)


QUERIES["lttb"] = lttb_view


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    x = Engine(types(spark, sf), lookback=DAY * SECOND).query_range("count_over_time(kinds[1d])", START, START + (DAYS - 1) * DAY, DAY)
    return render.matrix_json(x)


QUERIES["matrix_json"] = matrix
SQL["matrix_json"] = f"""WITH {E}, {G}, c AS (SELECT event_type, step, count(*) AS n FROM e JOIN g ON t BETWEEN step - {DAY}000000 AND step GROUP BY ALL)
    SELECT '{{"metric":{{"event_type":"' || event_type || '"}},"values":[' || string_agg('[' || step // 1000000 || ',"' || n || '"]', ',' ORDER BY step) || ']}}' AS json FROM c GROUP BY event_type"""


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """sum by (event_type) of events as of each day."""
    return QUERIES["agg_sum"](spark, sf)


def series_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical keys of label sets: equal for equal sets whatever the order of entries."""
    return table(spark, sf, "series").select("series_id", label_key(F.col("tags")).alias("series_key"))


QUERIES["series_keys"] = series_keys
SQL["series_keys"] = "SELECT series_id, list_aggregate(list_transform(list_sort(map_entries(tags)), lambda z: z.key || chr(2) || z.value), 'string_agg', chr(1)) AS series_key FROM series"
