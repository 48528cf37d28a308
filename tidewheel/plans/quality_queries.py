"""Queries of the core data-quality operators over the metric tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.implausible import flag_implausible, impossible
from tidewheel.operators.regular_grid import regular_grid
from tidewheel.operators.selection import skew_safe_summary
from tidewheel.plans.catalogue import significant, significant_sql
from tidewheel.session import epoch_micros, join_dimension, table


def bounded_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with epoch micros and whether their unit's hard bounds rule the value out."""
    series = table(spark, sf, "series").select("series_id", F.col("__name__").alias("name"))
    info = table(spark, sf, "metric_info").select(F.col("__name__").alias("name"), "unit", "is_signed")
    kinds = join_dimension(series, info, ["name"], "left").drop("name")
    samples = table(spark, sf, "samples")
    rows = samples.select("sample_id", "series_id", epoch_micros(samples, "timestamp").alias("ts"), "value").where("ts is not null and value is not null and not isnan(value)")
    return join_dimension(rows, kinds, ["series_id"], "left").withColumn("bad", impossible(F.col("value"), F.col("unit"), F.col("is_signed")))


def p1_flags(spark: SparkSession, sf: str) -> DataFrame:
    return flag_implausible(bounded_samples(spark, sf), "series_id", "ts", "value", "sample_id", "bad")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_flags(spark, sf).select("sample_id")


def sample_grid(spark: SparkSession, sf: str) -> DataFrame:
    samples = table(spark, sf, "samples")
    rows = samples.select("sample_id", "series_id", epoch_micros(samples, "timestamp").alias("ts"), "value").where("ts is not null and value is not null and not isnan(value)")
    rows = join_dimension(rows, table(spark, sf, "series").select("series_id", "step_s"), ["series_id"])
    return regular_grid(rows, "series_id", "ts", "value", "sample_id", "step_s")


def p3_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every period of every series; averages to nine significant digits."""
    grid = sample_grid(spark, sf)
    return grid.withColumn("avg", significant(F.col("avg")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return sample_grid(spark, sf).where("filled").select("series_id", "slot_start")


def keyed_samples(spark: SparkSession, sf: str) -> DataFrame:
    name = F.coalesce(F.col("__name__"), F.try_element_at("tags", F.lit("__name__")))
    return table(spark, sf, "samples").select(name.alias("metric_name"), F.try_element_at("tags", F.lit("service")).alias("service"), "value")


def p4_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Count, share and exact quantiles of every (metric, service) key; the heavy keys are marked."""
    got = skew_safe_summary(keyed_samples(spark, sf), ["metric_name", "service"], "value", [0.5, 0.9, 0.99], hot_share=0.03)
    q = F.col("quantiles")
    return got.select("metric_name", "service", "n_rows", "n_values", *((F.round(q[i] + F.lit(1e-9), 4) + F.lit(0.0)).alias(n) for i, n in enumerate(("p50", "p90", "p99"))), "is_hot")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_summary(spark, sf).where("is_hot").select("metric_name", "service")


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p4_found": p4_found, "p1_flags": p1_flags, "p3_grid": p3_grid, "p4_summary": p4_summary}

#: what "reading" means, for the SQL of problems 1, 3 and 4
_READING = "\"timestamp\" IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)"


def _stands_out(group: list[str], a: str, b: str) -> str:
    low, high = (f"{f}({', '.join(group)})" if len(group) > 1 else group[0] for f in ("least", "greatest"))
    return f"({a} IS NOT NULL AND {b} IS NOT NULL AND ({low} - greatest({a}, {b}) > lim OR least({a}, {b}) - {high} > lim))"


_GROUPS = [(["v"], "p1", "n1"), (["p1", "v"], "p2", "n1"), (["v", "n1"], "p1", "n2"), (["p2", "p1", "v"], "p3", "n1"), (["p1", "v", "n1"], "p2", "n2"), (["v", "n1", "n2"], "p1", "n3")]
_FLAGGED = f"""
        WITH kind AS (SELECT series_id, unit, coalesce(is_signed, false) AS is_signed FROM series LEFT JOIN metric_info USING (__name__)),
             d AS (SELECT series_id, "timestamp" AS t, arg_min(value, sample_id) AS v FROM samples WHERE {_READING} GROUP BY ALL),
             b AS (SELECT d.*, coalesce(isinf(v) OR v < CASE WHEN unit = 'celsius' THEN -273.15 WHEN is_signed THEN '-inf'::DOUBLE ELSE 0 END OR unit = 'ratio' AND v > 1 OR unit = 'percent' AND v > 100, false) AS bad
                   FROM d LEFT JOIN kind USING (series_id)),
             g AS (SELECT *, lag(v) OVER o AS p1, lag(v, 2) OVER o AS p2, lag(v, 3) OVER o AS p3, lead(v) OVER o AS n1, lead(v, 2) OVER o AS n2, lead(v, 3) OVER o AS n3
                   FROM b WHERE NOT bad WINDOW o AS (PARTITION BY series_id ORDER BY t)),
             m AS (SELECT series_id, 20 * median(abs(v - p1)) AS lim FROM g WHERE p1 IS NOT NULL GROUP BY series_id HAVING avg(CAST(v = p1 AS INT)) < 0.6),
             i AS (SELECT g.*, lim, sum(CASE WHEN v = p1 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY t) AS island FROM g JOIN m USING (series_id)),
             c AS (SELECT *, count(*) OVER (PARTITION BY series_id, island) AS same FROM i),
             f AS (SELECT series_id, t FROM b WHERE bad UNION SELECT series_id, t FROM c WHERE same >= 8 OR {' OR '.join(_stands_out(*x) for x in _GROUPS)})"""

SQL: dict[str, str] = {
    "p1_found": _FLAGGED + """
        SELECT sample_id FROM samples JOIN f ON samples.series_id = f.series_id AND samples."timestamp" = f.t WHERE value IS NOT NULL AND NOT isnan(value)""",
    "p3_grid": f"""
        WITH d AS (SELECT series_id, CAST(step_s AS BIGINT) * 1000000 AS w, epoch_us("timestamp") AS t, arg_min(value, sample_id) AS v FROM samples JOIN series USING (series_id) WHERE {_READING} GROUP BY ALL),
             h AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY series_id ORDER BY t), (t // w + 1) * w) AS until FROM d),
             x AS (SELECT *, unnest(range(CAST(t // w AS BIGINT), CAST((until - 1) // w AS BIGINT) + 1)) AS k FROM h),
             y AS (SELECT *, greatest(t, k * w) AS low, least(until, (k + 1) * w) AS high FROM x),
             z AS (SELECT series_id, w, k, sum(CAST(t >= k * w AS BIGINT)) AS n, sum(v * (high - low)) / sum(high - low) AS a, sum(greatest(0, least(high, t + w) - low)) AS cover FROM y GROUP BY ALL)
        SELECT series_id, CAST(k * w // 1000000 AS BIGINT) AS slot_start, CAST(n AS BIGINT) AS n_readings, {significant_sql("a")} AS avg, least(CAST(cover AS DOUBLE) / w, 1.0) AS coverage, n = 0 AS filled FROM z""",
    "p3_found": f"""
        WITH r AS (SELECT series_id, step_s, epoch_us("timestamp") // (step_s * 1000000) AS slot
                   FROM samples JOIN series USING (series_id) WHERE {_READING}),
             d AS (SELECT DISTINCT series_id, CAST(step_s AS BIGINT) AS step_s, CAST(slot AS BIGINT) AS slot FROM r),
             n AS (SELECT series_id, step_s, slot, lead(slot) OVER (PARTITION BY series_id ORDER BY slot) AS next FROM d)
        SELECT series_id, unnest(range(slot + 1, next)) * step_s AS slot_start FROM n WHERE next > slot + 1""",
    "p4_found": """
        WITH k AS (SELECT coalesce(__name__, tags['__name__']) AS metric_name, tags['service'] AS service FROM samples)
        SELECT metric_name, service FROM k WHERE metric_name IS NOT NULL AND service IS NOT NULL
        GROUP BY ALL HAVING count(*) >= 0.03 * (SELECT count(*) FROM samples)""",
    "p4_summary": """
        WITH k AS (SELECT coalesce(__name__, tags['__name__']) AS metric_name, tags['service'] AS service,
                          CASE WHEN isnan(value) THEN NULL ELSE value END AS v FROM samples)
        SELECT metric_name, service, count(*) AS n_rows, count(v) AS n_values, round(quantile_cont(v, 0.5) + 1e-9, 4) + 0.0 AS p50, round(quantile_cont(v, 0.9) + 1e-9, 4) + 0.0 AS p90,
               round(quantile_cont(v, 0.99) + 1e-9, 4) + 0.0 AS p99, count(*) >= 0.03 * (SELECT count(*) FROM samples) AS is_hot
        FROM k WHERE metric_name IS NOT NULL AND service IS NOT NULL GROUP BY ALL""",
}
