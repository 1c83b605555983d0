"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, packing, percentiles, toxicity
from tidewell.operators.common import DAY_NS, attach_dimension, floor_to, present
from tidewell.operators.late_events import to_ns
from tidewell.session import materialize, prepare
from tidewell.sources.tables import table

SCOPES = (("series", "series_id"), ("metric", "metric"))
QS = (0.01, 0.25, 0.5, 0.75, 0.99)
CAPACITY = 2048


def _values(spark: SparkSession, sf: str) -> DataFrame:
    """source, series_id, metric, block (UTC day of the time in ns), value of distinct rows with a value, of samples and input_log; series without a metric keep null."""
    dim = table(spark, sf, "series_dim").filter("series_id is not null").groupBy("series_id").agg(F.max("metric").alias("metric"))
    samples = table(spark, sf, "samples").select("series_id", F.col("ts_ns").alias("ts"), "value")
    log = table(spark, sf, "input_log").select(F.col("id").alias("series_id"), F.col("ts_raw").alias("ts"), "value")
    parts = []
    for name, rows, ns in (("samples", samples, F.col("ts")), ("input_log", log, to_ns(F.col("ts")))):
        rows = rows.filter(present("value")).withColumn("block", floor_to(ns, DAY_NS)).repartition("series_id", "block").dropDuplicates(["series_id", "block", "ts", "value"])
        parts.append(attach_dimension(rows, dim, "series_id", ["ts"], "left").select(F.lit(name).alias("source"), "series_id", "metric", "block", "value"))
    return reduce(DataFrame.unionByName, parts)


def p2_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    rows = materialize(_values(spark, sf).select("source", "series_id", "metric", "value"))
    parts = percentiles.percentiles_of_scopes(rows, [["source", c] for _, c in SCOPES], QS)
    named = [p.filter(F.col(c).isNotNull()).select("source", F.lit(scope).alias("scope"), F.col(c).cast("string").alias("name"), "q", "n", "value") for p, (scope, c) in zip(parts, SCOPES, strict=True)]
    return reduce(DataFrame.unionByName, named)


def p2_from_days(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per series and per metric from day-wise histograms that are merged; value within error_bound of the exact one, 2^-8 of it."""
    prepare(spark)
    days = materialize(percentiles.histograms(_values(spark, sf).filter("series_id is not null"), ["source", "series_id", "metric"], ["block"]))
    scopes = [days.filter(F.col(c).isNotNull()).select("source", F.lit(scope).alias("scope"), F.col(c).cast("string").alias("name"), "bucket", "n") for scope, c in SCOPES]
    merged = materialize(percentiles.merge_histograms(scopes, ["source", "scope", "name"]))
    return percentiles.percentiles_of_histograms(merged, ["source", "scope", "name"], QS)


def p2_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the percentiles of merged days keep their bounds, against the exact ones."""
    keys = ["source", "scope", "name", "q"]
    both = p2_from_days(spark, sf).join(p2_percentiles(spark, sf).withColumnRenamed("value", "exact").drop("n"), keys)
    # an infinite percentile is met exactly; a bound may be missed by the rounding of its own last bit
    near = (F.col("value") == F.col("exact")) | (F.abs(F.col("value") - F.col("exact")) <= F.col("error_bound") * (1 + 1e-9))
    return both.select(*keys, "n", near.alias("kept"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    return bpe.encode(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Whether decoding the ids gives back each text."""
    prepare(spark)
    docs = bpe.encode(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", (bpe.decode(F.col("ids")) == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("same"))


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf, "documents")
    sized = bpe.token_counts(docs.select("doc_id", "text")).select("doc_id", "n_tokens")
    out = packing.pack(sized, CAPACITY, "doc_id", "n_tokens", rows=docs.count())
    return out.select(F.col("id").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), "container", "place", "start")


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold for containers: no token lost, none over-full, only long texts cut, pieces in places without gaps, few containers."""
    rows = materialize(p7_packed(spark, sf))
    boxes = rows.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.max("place").alias("last"), F.count_distinct("place").alias("places"), F.count("*").alias("items"))
    docs = rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("pieces"))
    of_boxes = boxes.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), (F.coalesce(F.max("used"), F.lit(0)) <= CAPACITY).alias("none_overfull"), F.coalesce(F.bool_and((F.col("last") + 1 == F.col("items")) & (F.col("places") == F.col("items"))), F.lit(True)).alias("places_in_order"))
    of_docs = docs.agg(F.count("*").alias("docs"), F.coalesce(F.bool_and((F.col("pieces") == 1) | (F.col("size") > CAPACITY)), F.lit(True)).alias("only_long_cut"))
    # a shard's last containers may be half empty; beside that hardly anything is left over
    few = F.col("containers") <= F.ceil(F.col("tokens") / CAPACITY * 1.02) + 10
    return of_boxes.join(F.broadcast(of_docs)).select("docs", "none_overfull", "places_in_order", "only_long_cut", few.alias("few_containers"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Room left in the containers: number of containers by tenth of the capacity used."""
    used = p7_packed(spark, sf).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return used.groupBy(F.floor(F.col("used") * 10 / CAPACITY).cast("int").alias("tenths")).agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    parts = materialize(toxicity.prepared(table(spark, sf, "documents")))
    return toxicity.scores(parts, toxicity.train(parts, table(spark, sf, "review_samples")))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).filter(F.col("score") >= toxicity.THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf)


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.rates(_scored(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_percentiles": p2_percentiles,
    "p2_from_days": p2_from_days,
    "p2_bounds": p2_bounds,
    "p6_ids": p6_ids,
    "p6_round_trip": p6_round_trip,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p7_invariants": p7_invariants,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}

_VALUES = """
WITH dim AS (SELECT series_id, max(metric) AS metric FROM series_dim WHERE series_id IS NOT NULL GROUP BY 1),
v AS (
  SELECT 'samples' AS source, series_id, value FROM (SELECT DISTINCT series_id, ts_ns, value FROM samples WHERE value IS NOT NULL AND NOT isnan(value))
  UNION ALL SELECT 'input_log', id, value FROM (SELECT DISTINCT id, ts_raw, value FROM input_log WHERE value IS NOT NULL AND NOT isnan(value))),
g AS (
  SELECT source, 'series' AS scope, CAST(series_id AS VARCHAR) AS name, value FROM v WHERE series_id IS NOT NULL
  UNION ALL SELECT source, 'metric', metric, value FROM v JOIN dim USING (series_id) WHERE metric IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY source, scope, name ORDER BY value) AS rk, count(*) OVER (PARTITION BY source, scope, name) AS n FROM g),
q AS (SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99]::DOUBLE[]) AS q)
"""

ORACLE: dict[str, str] = {
    "p2_percentiles": _VALUES + "SELECT source, scope, name, q, n, value FROM r JOIN q ON rk = greatest(1, CAST(ceil(q * n) AS BIGINT))",
    "p2_bounds": _VALUES + "SELECT source, scope, name, q, n, true AS kept FROM r JOIN q ON rk = greatest(1, CAST(ceil(q * n) AS BIGINT))",
    "p7_invariants": "SELECT count(DISTINCT doc_id) AS docs, true AS none_overfull, true AS places_in_order, true AS only_long_cut, true AS few_containers FROM documents",
    "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
}
