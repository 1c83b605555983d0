"""Joins of metrics on equal tags and times.

A join of n metrics is one conditional aggregation over (tags, time): a single shuffle in which partial
aggregation already happens on the map side, instead of n - 1 full outer joins. An element is null where
its metric has no value; rows exist for the tags of the first metric only. Columns are c0, c1, …
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.aggregate import bucket_column, bucket_of
from tidewell.operators.common import attach_dimension
from tidewell.operators.select import bounded, combined
from tidewell.plans.spec import Query


def element_names(q: Query) -> list[str]:
    return [f"c{i}" for i in range(len(q.metrics))]


def _driving(rows: DataFrame, series: DataFrame, q: Query) -> DataFrame:
    """Rows whose tags some selected series of the first metric has."""
    keys = series.filter(F.col("metric") == q.metrics[0]).select("tag_key").distinct()
    return attach_dimension(rows, keys, "tag_key", ["ts_ns"])


def _named(out: DataFrame, q: Query) -> DataFrame:
    return out.select(F.concat(F.lit("|".join(q.metrics) + " "), F.col("tag_key")).alias("series"), "ts_ns", *element_names(q))


def _values(q: Query) -> list[Column]:
    """Each metric's value as a column that is null on rows of other metrics."""
    return [F.when(F.col("metric") == m, F.col("value")) for m in q.metrics]


def _kept(out: DataFrame, q: Query) -> DataFrame:
    """Apply filters to elements: a failing one becomes null. A row goes if nothing is left, or with "all" never for one alone."""
    limits = dict(q.filters)
    names = element_names(q)
    if limits:
        out = out.select("tag_key", "ts_ns", *((F.when(bounded(F.col(c), limits[m]), F.col(c)) if m in limits else F.col(c)).alias(c) for c, m in zip(names, q.metrics, strict=True)))
    return out.filter(combined([F.col(c).isNotNull() for c in names], True))


def joined(rows: DataFrame, series: DataFrame, q: Query) -> DataFrame:
    """The join statement."""
    out = _driving(rows, series, q).groupBy("tag_key", "ts_ns").agg(*(F.max(v).alias(c) for c, v in zip(element_names(q), _values(q), strict=True)))
    return _named(_kept(out, q), q)


def joined_buckets(rows: DataFrame, series: DataFrame, q: Query) -> DataFrame:
    """The group-aggregate-join statement: aggregate each metric per bucket, then join on the bucket."""
    keyed = _driving(rows, series, q).withColumn("bucket", bucket_of(F.col("ts_ns"), q.range, q.step))
    cols = []
    for c, v in zip(element_names(q), _values(q), strict=True):
        made = bucket_column(q.functions[0], v)
        # a metric without rows in the bucket is a hole, not a count of 0
        cols.append((F.when(F.count(v) > 0, made) if q.functions[0] == "count" else made).alias(c))
    out = keyed.groupBy("tag_key", "bucket").agg(*cols).withColumnRenamed("bucket", "ts_ns")
    return _named(_kept(out, q), q)
