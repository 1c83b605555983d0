"""Series selection, time ranges, value filters, and the projection of tags to output names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.errors import NoData, NotFound
from tidewell.functions import names
from tidewell.operators.common import attach_dimension
from tidewell.plans.spec import Bounds, Query, Range


def in_range(rows: DataFrame, r: Range | None) -> DataFrame:
    """Literals on the raw column, so that the predicate reaches the Parquet scan."""
    if r is None:
        return rows
    ts = F.col("ts_ns")
    return rows.filter((ts > r.end) & (ts <= r.begin) if r.backward else (ts >= r.begin) & (ts < r.end))


def bounded(value: Column, b: Bounds) -> Column:
    """True where a value keeps within limits; exclusive limits win over inclusive ones."""
    parts = []
    if b.gt is not None or b.ge is not None:
        parts.append(value > b.gt if b.gt is not None else value >= b.ge)
    if b.lt is not None or b.le is not None:
        parts.append(value < b.lt if b.lt is not None else value <= b.le)
    return reduce(lambda x, y: x & y, parts)


def combined(conditions: list[Column], any_of: bool) -> Column:
    return reduce(lambda x, y: x | y if any_of else x & y, conditions)


def matching_series(series: DataFrame, q: Query, metrics: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of the dimension that a query's metrics and where clause select."""
    metrics = q.metrics if metrics is None else metrics
    out = series.filter(F.col("metric").isin(list(metrics))) if metrics else series
    for tag, values in q.where:
        out = out.filter(F.element_at("tags", tag).isin(list(values)) if values else F.lit(False))
    if q.exact:
        texts = [" ".join(f"{k}={v}" for k, v in tags) for tags in q.exact]
        out = out.filter(names.tag_text(F.col("tags")).isin(texts))
    return out


def known_tags(series: DataFrame, q: Query) -> list[str]:
    """Grouping tags that some series of the metrics has. Unknown ones don't matter to a dropping projection."""
    some = series.filter(F.col("metric").isin(list(q.metrics))).select(*(F.max(F.map_contains_key("tags", t)).alias(f"t{i}") for i, t in enumerate(q.tags))).first()
    return [t for i, t in enumerate(q.tags) if some and some[f"t{i}"]]


def projected(series: DataFrame, q: Query) -> DataFrame:
    """Add ``tag_key``, the text of the tags that stay in the output; drops series that the grouping leaves out."""
    if not q.tags:
        return series.withColumn("tag_key", names.tag_text(F.col("tags")))
    known = known_tags(series, q)
    if q.keep_tags and len(known) < len(q.tags):
        raise NoData("no series has the tags of the grouping")
    kept = names.keep_tags(F.col("tags"), q.tags) if q.keep_tags else names.drop_tags(F.col("tags"), q.tags)
    out = series.filter(names.has_tags(F.col("tags"), known)).withColumn("tag_key", names.tag_text(kept)).filter("tag_key <> ''")
    if out.isEmpty():
        raise NoData("no series has the tags of the grouping")
    return out


def selection(series: DataFrame, q: Query) -> tuple[DataFrame, tuple[int, int] | None]:
    """series_id, metric and tag_key of the selected series, and bounds of their rows and bytes where they are known.

    Raises NotFound for metrics without series.
    """
    chosen = matching_series(series, q)
    sizes = {r.metric: (r.n, r.b) for r in chosen.groupBy("metric").agg(F.count("*").alias("n"), F.sum(F.octet_length("series") + F.octet_length("metric")).alias("b")).collect()} if q.metrics else {}
    needed = q.metrics[:1] if q.kind in ("join", "group-aggregate-join") else q.metrics
    if missing := [m for m in needed if m not in sizes]:
        raise NotFound(f"not found: {missing[0]}")
    return projected(chosen, q).select("series_id", "metric", "tag_key"), (sum(n for n, _ in sizes.values()), sum(b for _, b in sizes.values())) if q.metrics else None


def selected(rows: DataFrame, series: DataFrame, q: Query) -> DataFrame:
    """Rows in range of the selected series, with ``metric`` and ``tag_key``.

    The dimension is joined by broadcast after a count, else with salted keys, so one series may hold any
    share of the rows.
    """
    dim, n = selection(series, q)
    return attach_dimension(in_range(rows, q.range), dim, "series_id", ["ts_ns"], size=n)
