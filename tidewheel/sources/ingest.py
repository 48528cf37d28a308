"""Text and record formats of metrics, parsed in the JVM into sample rows: labels, ts (microseconds), value.

Every parser leaves out lines it can't read; ``rejected`` counterparts give those lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions.paths import glob_to_regex
from tidewheel.operators.frames import NAME, SECOND

CARBON = r"^\s*(\S+)\s+([-+]?(?:\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|nan|NaN|inf|Inf|\+Inf|-Inf))\s+(-?\d+(?:\.\d+)?)\s*$"


def path_labels(path: Column) -> Column:
    """A dotted path as labels __g0__, __g1__, ... ; one dot at the end is dropped."""
    parts = F.split(F.regexp_replace(path, r"\.$", ""), r"\.")
    return F.map_from_entries(F.transform(parts, lambda p, i: F.struct(F.concat(F.lit("__g"), i.cast("string"), F.lit("__")).alias("key"), p.alias("value"))))


def carbon(lines: DataFrame, column: str = "value") -> DataFrame:
    """``path value seconds`` lines: path, labels, ts, value. Empty path parts and negative times are rejected; the time -1 is none."""
    m = F.regexp_extract
    line = F.col(f"`{column}`")
    parsed = lines.where(line.rlike(CARBON)).select(m(line, CARBON, 1).alias("path"), F.expr(f"try_cast(regexp_extract(`{column}`, r'{CARBON}', 2) as double)").alias("value"), m(line, CARBON, 3).cast("double").alias("s"))
    good = parsed.where(~F.col("path").rlike(r"^\.|\.\.") & (F.col("s") >= 0))
    return good.select("path", path_labels(F.col("path")).alias("labels"), (F.col("s") * SECOND).cast("bigint").alias("ts"), "value")


def carbon_rejected(lines: DataFrame, column: str = "value") -> DataFrame:
    line = F.col(f"`{column}`")
    return lines.where(~line.rlike(CARBON) | F.regexp_extract(line, CARBON, 1).rlike(r"^\.|\.\."))


def carbon_rules(points: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds aggregation and policy by the first rule (pattern or text contained, aggregation, policy) whose pattern is found in the path."""
    agg = pol = F.lit(None).cast("string")
    for pattern, aggregation, policy in reversed(rules):
        test = F.col("path").rlike(pattern)
        agg, pol = F.when(test, F.lit(aggregation)).otherwise(agg), F.when(test, F.lit(policy)).otherwise(pol)
    return points.withColumn("aggregation", agg).withColumn("policy", pol)


def influx(lines: DataFrame, column: str = "value", precision: str = "ns") -> DataFrame:
    """Line protocol ``measurement,tag=v field=1,other=2i time``: a row per numeric or boolean field, named measurement_field.

    Text fields are left out. Commas, spaces and equal signs may be escaped by a backslash. A line without time has a null ts.
    """
    line = F.trim(F.col(f"`{column}`"))
    unescape = lambda c: F.regexp_replace(c, r"\\([,= ])", "$1")
    clean = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    parts = F.split(line, r"(?<!\\) (?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")
    rows = lines.where((line != "") & ~line.startswith("#")).select(parts.alias("p")).where("size(p) between 2 and 3")
    head = F.split(F.col("p")[0], r"(?<!\\),")
    tags = F.transform(F.slice(head, 2, F.size(head)), lambda t: F.struct(clean(unescape(F.regexp_extract(t, r"^((?:[^=\\]|\\.)*)=", 1))).alias("key"), unescape(F.regexp_extract(t, r"^(?:[^=\\]|\\.)*=(.*)$", 1)).alias("value")))
    fields = F.split(F.col("p")[1], r"(?<!\\),(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")
    time = "try_cast(p[2] as bigint)"
    ts = F.expr({"ns": f"({time} - pmod({time}, 1000L)) div 1000L", "us": time, "u": time, "ms": f"{time} * 1000L", "s": f"{time} * {SECOND}L"}[precision])
    each = rows.select(clean(unescape(head[0])).alias("m"), tags.alias("tags"), F.when(F.size("p") > 2, ts).cast("bigint").alias("ts"), fields.alias("fields"))
    each = each.select("m", "tags", "ts", F.explode("fields").alias("f"))
    name = clean(unescape(F.regexp_extract("f", r"^((?:[^=\\]|\\.)*)=", 1)))
    raw = F.regexp_extract("f", r"^(?:[^=\\]|\\.)*=(.*)$", 1)
    each = each.withColumn("name", F.concat_ws("_", "m", name)).withColumn("raw", raw)
    value = F.when(F.col("raw").rlike(r"^(?i)(t|true)$"), 1.0).when(F.col("raw").rlike(r"^(?i)(f|false)$"), 0.0).otherwise(F.expr(r"try_cast(regexp_replace(raw, '[iu]$', '') as double)"))
    labels = F.map_from_entries(F.concat(F.filter("tags", lambda t: t["key"] != NAME), F.array(F.struct(F.lit(NAME).alias("key"), F.col("name").alias("value")))))
    return each.select(labels.alias("labels"), "ts", value.alias("value")).where("value is not null and not isnan(value)")


WRITE_SCHEMA = T.StructType([T.StructField("tags", T.MapType(T.StringType(), T.StringType())), T.StructField("timestamp", T.StringType()), T.StructField("value", T.DoubleType())])


def json_write(lines: DataFrame, column: str = "value") -> DataFrame:
    """``{"tags": {...}, "timestamp": seconds or RFC 3339, "value": v}`` per line."""
    rows = lines.select(F.from_json(F.col(f"`{column}`"), WRITE_SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).where("r.value is not null and r.timestamp is not null and size(r.tags) > 0")
    seconds = F.expr("try_cast(r.timestamp as double)")
    ts = F.coalesce((seconds * SECOND).cast("bigint"), F.unix_micros(F.expr("try_to_timestamp(r.timestamp)")))
    return rows.select(F.col("r.tags").alias("labels"), ts.alias("ts"), F.col("r.value").alias("value")).where("ts is not null")


def remote_write(series: DataFrame) -> DataFrame:
    """Structured write requests (labels array<struct<name,value>>, samples array<struct<timestamp ms, value>>) to sample rows."""
    labels = F.map_from_entries(F.transform("labels", lambda l: F.struct(l["name"].alias("key"), l["value"].alias("value"))))
    rows = series.select(labels.alias("labels"), F.explode("samples").alias("s"))
    return rows.select("labels", (F.col("s.timestamp") * 1000).cast("bigint").alias("ts"), F.col("s.value").alias("value"))


def remote_read(vector: DataFrame) -> DataFrame:
    """The opposite: one row per series with its samples in time order."""
    labels = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    rows = vector.select(labels.alias("labels"), F.struct(F.floor(F.col("step") / 1000).alias("timestamp"), "value").alias("s"))
    return rows.groupBy("labels").agg(F.sort_array(F.collect_list("s")).alias("samples"))


def valid_tags(rows: DataFrame) -> DataFrame:
    """Rows whose labels have no empty name or value and only names of letters, digits and underscores."""
    good = F.forall(F.map_entries("labels"), lambda e: (e["value"] != "") & e["key"].rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"))
    return rows.where((F.size("labels") > 0) & good)


def prom_type_route(rows: DataFrame, kind: str = "prom_type") -> DataFrame:
    """Adds the aggregator's kind of a typed metric: counters stay counters, all others are gauges; dotted paths starting with stats.timers are timers."""
    name = F.coalesce(F.try_element_at("labels", F.lit(NAME)), F.try_element_at("labels", F.lit("__g0__")))
    t = F.lower(F.coalesce(F.col(kind), F.lit("")))
    routed = F.when(t.isin("counter", "histogram", "summary"), "counter").when(t == "timer", "timer").when(name == "stats", F.when(F.try_element_at("labels", F.lit("__g1__")) == "timers", "timer").when(F.try_element_at("labels", F.lit("__g1__")) == "counts", "counter").otherwise("gauge")).otherwise("gauge")
    return rows.withColumn("kind", routed)


def glob_filter(rows: DataFrame, column: str, glob: str) -> DataFrame:
    return rows.where(F.col(f"`{column}`").rlike(f"^{glob_to_regex(glob)}$"))
