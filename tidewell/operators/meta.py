"""Metadata: names of series, search, suggestions and the topology of tags. All of it reads the dimension only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.select import matching_series
from tidewell.plans.spec import Query


def series_names(series: DataFrame, q: Query) -> DataFrame:
    """Names of the series that a request selects."""
    return matching_series(series, q).select("series").distinct()


def names_like(series: DataFrame, pattern: str) -> DataFrame:
    """Names of series in which a regular expression is found."""
    return series.filter(F.col("series").rlike(pattern)).select("series").distinct()


def suggestions(series: DataFrame, q: Query) -> DataFrame:
    """Metric names, tag names of a metric, or values of a tag, by prefix."""
    if q.kind == "metric-names":
        out = series.select(F.col("metric").alias("name"))
    else:
        of = series.filter(F.col("metric") == q.metrics[0])
        if q.kind == "tag-names":
            out = of.select(F.explode(F.map_keys("tags")).alias("name"))
        else:
            out = of.select(F.element_at("tags", q.tag).alias("name")).filter("name is not null")
    return (out.filter(F.col("name").startswith(q.starts_with)) if q.starts_with else out).distinct()


def topology(series: DataFrame) -> DataFrame:
    """metric, tag, value and the number of series for each."""
    return series.select("metric", F.explode("tags").alias("tag", "tag_value")).groupBy("metric", "tag", "tag_value").agg(F.count("*").alias("n_series"))


def without_tags(series: DataFrame, q: Query) -> DataFrame:
    """Series of the metrics that the where clause doesn't select."""
    return series.filter(F.col("metric").isin(list(q.metrics))).join(matching_series(series, q).select("series_id"), "series_id", "left_anti")


def same_tags(series: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Tag sets with, per metric in order, the id of the series that carries them, null where it is missing."""
    from tidewell.functions.names import tag_text

    keyed = series.filter(F.col("metric").isin(list(metrics))).withColumn("tag_key", tag_text(F.col("tags")))
    return keyed.groupBy("tag_key").agg(*(F.max(F.when(F.col("metric") == m, F.col("series_id"))).alias(f"id{i}") for i, m in enumerate(metrics))).filter("id0 is not null")
