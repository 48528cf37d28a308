"""Queries of the text and sketch operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.bitmaps import build_bitmaps, estimate_distinct, merge_bitmaps
from tidewheel.llm.dyadic import build_sketches, merge_sketches, sketch_quantiles
from tidewheel.llm.leaks import find_leaks
from tidewheel.llm.mixing import mix_sources, mixing_report
from tidewheel.llm.same_reading import consistent_texts, reading_classes, same_reading_pairs
from tidewheel.session import table


def p6_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with an exact, edited or paraphrased passage of a test item."""
    return find_leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "passage")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_leaks(spark, sf).where("longest_run >= 12").select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_reading_pairs(table(spark, sf, "documents"), "doc_id", "text")


def p8_forms(spark: SparkSession, sf: str) -> DataFrame:
    return consistent_texts(table(spark, sf, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    return reading_classes(table(spark, sf, "documents"), "doc_id", "text")


def _tags(names: list[str]) -> list[Column]:
    return [F.try_element_at("tags", F.lit(t)).alias(t) for t in names]


def _by_tag(sketches: DataFrame) -> DataFrame:
    """Tag and tag_value, both null for the whole."""
    return sketches.withColumnRenamed("facet", "tag").withColumnRenamed("facet_value", "tag_value")


def _spread(df: DataFrame) -> DataFrame:
    q = F.col("quantiles")
    return df.select("*", q[0].alias("p50"), q[1].alias("p90"), q[2].alias("p99")).drop("quantiles")


PROBS = [0.5, 0.9, 0.99]


def sample_sketches(spark: SparkSession, sf: str) -> DataFrame:
    name = F.coalesce(F.col("__name__"), F.try_element_at("tags", F.lit("__name__"))).alias("metric_name")
    tags = ["service", "region", "env", "instance"]
    rows = table(spark, sf, "samples").select(name, *_tags(tags), "value")
    built = _by_tag(build_sketches(rows, ["metric_name"], "value", facets=tags))
    return merge_sketches(built, ["metric_name", "tag", "tag_value"], tasks=rows.rdd.getNumPartitions())


def p2_sample_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Median and high percentiles of samples per metric name and tag, with the error stated."""
    return _spread(sketch_quantiles(sample_sketches(spark, sf), ["metric_name", "tag", "tag_value"], PROBS))


def day_sketches(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "unaggregated")
    name = F.coalesce(F.col("__name__"), F.split_part("id", F.lit("+"), F.lit(1))).alias("metric_name")
    values = F.when(F.col("type") == "timer", F.col("batch_timer")).when(F.col("type") == "gauge", F.array("gauge_val")).when(F.col("type") == "counter", F.array(F.col("counter_val").cast("double")))
    tags = ["app", "region", "client"]
    rows = t.select(name, "type", F.to_date("timestamp").cast("string").alias("day"), *_tags(tags), F.explode(values).alias("value"))
    built = _by_tag(build_sketches(rows, ["metric_name", "type", "day"], "value", facets=tags))
    return merge_sketches(built, ["metric_name", "type", "day", "tag", "tag_value"], tasks=rows.rdd.getNumPartitions())


def p2_day_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of timers, gauges and counters per name, tag and day. Nearly all groups are a client's few values: small ones are read off."""
    return _spread(sketch_quantiles(day_sketches(spark, sf), ["metric_name", "type", "day", "tag", "tag_value"], PROBS, exact_small=True))


def p2_week_from_days(spark: SparkSession, sf: str) -> DataFrame:
    """The days' sketches added up to the whole week, per name and tag."""
    keys = ["metric_name", "type", "tag", "tag_value"]
    return _spread(sketch_quantiles(merge_sketches(day_sketches(spark, sf), keys), keys, PROBS, exact_small=True))


def _or_none(tag: str) -> Column:
    return F.coalesce(F.try_element_at("tags", F.lit(tag)), F.lit("(none)"))


def p5_client_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct clients per day, name, region, app and every combination of them; null means all, "summed" tells over which."""
    t = table(spark, sf, "unaggregated")
    name = F.coalesce(F.col("__name__"), F.split_part("id", F.lit("+"), F.lit(1)))
    rows = t.select(F.coalesce(F.to_date("timestamp").cast("string"), F.lit("(none)")).alias("day"), name.alias("metric_name"), _or_none("region").alias("region"), _or_none("app").alias("app"), F.try_element_at("tags", F.lit("client")).alias("client"))
    keys = ["day", "metric_name", "region", "app"]
    return estimate_distinct(merge_bitmaps(build_bitmaps(rows, keys, "client"), keys, combinations=True))


def p5_instance_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct instances of samples per day, name and region and every combination."""
    t = table(spark, sf, "samples")
    name = F.coalesce(F.col("__name__"), F.try_element_at("tags", F.lit("__name__")), F.lit("(none)"))
    rows = t.select(F.coalesce(F.to_date("timestamp").cast("string"), F.lit("(none)")).alias("day"), name.alias("metric_name"), _or_none("region").alias("region"), F.try_element_at("tags", F.lit("instance")).alias("instance"))
    keys = ["day", "metric_name", "region"]
    return estimate_distinct(merge_bitmaps(build_bitmaps(rows, keys, "instance"), keys, combinations=True))


def p5_distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Both: distinct clients of unaggregated and distinct instances of samples, per day, name, region, app and every combination."""
    clients, instances = p5_client_counts(spark, sf), p5_instance_counts(spark, sf)
    return clients.select(F.lit("client").alias("counted"), "*").unionByName(instances.select(F.lit("instance").alias("counted"), "*"), allowMissingColumns=True)


#: Where the public vocabulary files lie; a parameter of the deployment.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is used so that every source has its target share of the tokens."""
    return mix_sources(table(spark, sf, "documents"), "doc_id", "text", "source", table(spark, sf, "mix_targets"), TOKENIZER)


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual shares."""
    return mixing_report(p7_mixture(spark, sf), "source", table(spark, sf, "mix_targets"))


QUERIES = {
    "p2_sample_percentiles": p2_sample_percentiles, "p2_day_percentiles": p2_day_percentiles, "p2_week_from_days": p2_week_from_days, "p5_distinct_counts": p5_distinct_counts, "p5_client_counts": p5_client_counts, "p5_instance_counts": p5_instance_counts,
    "p6_found": p6_found, "p6_leaks": p6_leaks, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_forms": p8_forms, "p8_classes": p8_classes,
}

SQL: dict[str, str] = {}
