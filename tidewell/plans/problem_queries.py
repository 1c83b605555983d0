"""Queries of the general data problems (late events, regular grids, trailing totals, spikes) and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import late_events, regular_grid, spikes, trailing
from tidewell.operators.common import attach_dimension, series_metrics
from tidewell.session import materialize, prepare, remove_at_exit, shared_folder
from tidewell.sources.tables import table
from tidewell.streaming.late_store import LateStore


def _series(spark: SparkSession, sf: str) -> DataFrame:
    return series_metrics(table(spark, sf, "series_dim"), table(spark, sf, "metric_defs"))


def _of_kind(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Samples of the series of one kind of metric, with the metric's step and range."""
    dim = _series(spark, sf).filter(F.col("kind") == kind).select("series_id", "step_ns", "lo", "hi")
    return attach_dimension(table(spark, sf, "samples").select("series_id", "ts_ns", "value"), dim, "series_id", ["ts_ns"])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    parts = late_events.hourly(table(spark, sf, "input_log"), _series(spark, sf))
    return late_events.combine(parts).filter("n_late > 0").select(F.col("key").alias("id"), F.col("period_ns").alias("hour_ns"))


def p1_hourly(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    return _tidied_hours(late_events.combine(late_events.hourly(table(spark, sf, "input_log"), _series(spark, sf))))


def _tidied_hours(out: DataFrame) -> DataFrame:
    total = F.when(F.abs("total") < 1e12, F.round("total", 5)).otherwise(F.col("total"))
    return out.select(F.col("key").alias("id"), F.col("period_ns").alias("hour_ns"), "n", total.alias("total"), "least", "most", "n_late")


def p1_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly aggregates read from a store to which the log came in three batches, in the order of arrival."""
    prepare(spark)
    folder = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    log = table(spark, sf, "input_log")
    store = LateStore(spark, folder, materialize(late_events.cutoffs_of(_series(spark, sf))))
    last = log.agg(F.max("log_seq")).first()[0] or 0
    for batch in range(3):
        store.add(log.filter((F.col("log_seq") > last * batch // 3 - (batch == 0)) & (F.col("log_seq") <= last * (batch + 1) // 3)), batch)
    return _tidied_hours(store.read())


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    rows = _of_kind(spark, sf, "gauge").select("series_id", "ts_ns", "value", "step_ns")
    return regular_grid.found_empty(regular_grid.grid(rows)).select(F.col("key").alias("series_id"), "slot_ns")


def p3_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The grid of all gauges. An impossible reading is one, but like an infinite one it has no weight in a fit."""
    prepare(spark)
    impossible = F.coalesce(F.col("value") < F.col("lo"), F.lit(False)) | F.coalesce(F.col("value") > F.col("hi"), F.lit(False))
    rows = _of_kind(spark, sf, "gauge").withColumn("value", F.when(impossible & ~F.isnan("value"), float("inf")).otherwise(F.col("value")))
    return regular_grid.grid(rows, two_sided=True).select(F.col("key").alias("series_id"), "slot_ns", "value", "n_readings", "support", "missing", "filled")


def p3_check(spark: SparkSession, sf: str) -> DataFrame:
    """The grid with rounded values, for comparison."""
    out = p3_grid(spark, sf)
    return out.select("series_id", "slot_ns", F.round("value", 3).alias("value"), "n_readings", F.round("support", 6).alias("support"), "missing", "filled")


def _day(col: str) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col(col).cast("int")), "yyyy-MM-dd")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    out = trailing.trailing(trailing.daily_totals(_of_kind(spark, sf, "counter")))
    hit = (10 * F.col("t7") > 7 * F.col("t30")) | (300 * F.col("t7") < 7 * F.col("t30"))
    return out.filter(hit & (F.col("day") >= F.col("first_day") + 29) & (F.col("day") <= F.col("last_day"))).select(F.col("key").alias("series_id"), _day("day").alias("day_utc"))


def p4_trailing(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    out = trailing.trailing(trailing.daily_totals(table(spark, sf, "samples")))
    tidy = [F.when(F.abs(c) < 1e12, F.round(c, 5)).otherwise(F.col(c)).alias(c) for c in ("t7", "t30", "avg7", "avg30")]
    return out.select(F.col("key").alias("series_id"), _day("day").alias("day_utc"), *tidy)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    return spikes.implausible(_of_kind(spark, sf, "gauge")).select(F.col("key").alias("series_id"), F.col("ts").alias("ts_ns"))


def p5_flags(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    return spikes.implausible(_of_kind(spark, sf, "gauge")).select(F.col("key").alias("series_id"), F.col("ts").alias("ts_ns"), "value", "impossible", "stuck", "spike")


def p5_impossible(spark: SparkSession, sf: str) -> DataFrame:
    """The readings flagged as impossible."""
    return p5_flags(spark, sf).filter("impossible").select("series_id", "ts_ns", "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_hourly": p1_hourly,
    "p1_stored": p1_stored,
    "p3_found": p3_found,
    "p3_grid": p3_grid,
    "p3_check": p3_check,
    "p4_found": p4_found,
    "p4_trailing": p4_trailing,
    "p5_found": p5_found,
    "p5_flags": p5_flags,
    "p5_impossible": p5_impossible,
}

_P1_POINTS = """
WITH dim AS (SELECT DISTINCT series_id, metric FROM series_dim),
cut AS (SELECT dim.series_id, any_value(late_cutoff_s) * 1000000 AS cutoff_us FROM dim JOIN metric_defs USING (metric) WHERE late_cutoff_s IS NOT NULL GROUP BY 1),
pts AS (
  SELECT id, CASE WHEN abs(ts_raw) < 100000000000 THEN ts_raw * 1000000000 WHEN abs(ts_raw) < 100000000000000 THEN ts_raw * 1000000
                  WHEN abs(ts_raw) < 100000000000000000 THEN ts_raw * 1000 ELSE ts_raw END AS ts_ns, value, min(epoch_us(arrived_at)) AS arr
  FROM input_log WHERE id IS NOT NULL AND ts_raw IS NOT NULL AND arrived_at IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
j AS (
  SELECT id, ts_ns // 3600000000000 * 3600000000000 AS hour_ns, value, arr, cutoff_us FROM pts JOIN cut ON id = series_id),
k AS (
  SELECT *, CASE WHEN arr < hour_ns // 1000 + 3600000000 THEN 0 WHEN arr <= hour_ns // 1000 + 3600000000 + cutoff_us THEN 1 ELSE 2 END AS lateness FROM j)
"""

_TIDY = "CASE WHEN abs({0}) < 1e12 THEN round({0}, 5) ELSE {0} END AS {1}"

_HOURS = f"SELECT id, hour_ns, count(*) AS n, {_TIDY.format('sum(value)', 'total')}, min(value) AS least, max(value) AS most, CAST(sum(lateness) AS BIGINT) AS n_late FROM k WHERE lateness < 2 GROUP BY id, hour_ns"

_DAILY = """
WITH pts AS (SELECT DISTINCT s.series_id, ts_ns, value FROM samples s {join} WHERE s.series_id IS NOT NULL AND ts_ns IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)),
daily AS (SELECT series_id, ts_ns // 86400000000000 AS day, sum(value) AS total FROM pts GROUP BY ALL),
life AS (SELECT series_id, min(day) AS first_day, max(day) AS last_day FROM daily GROUP BY 1),
days AS (SELECT series_id, first_day, last_day, unnest(generate_series(first_day, last_day)) AS day FROM life),
dense AS (SELECT days.*, coalesce(total, 0) AS total FROM days LEFT JOIN daily USING (series_id, day)),
t AS (SELECT *, sum(total) OVER (PARTITION BY series_id ORDER BY day ROWS 6 PRECEDING) AS t7, sum(total) OVER (PARTITION BY series_id ORDER BY day ROWS 29 PRECEDING) AS t30 FROM dense)
"""

_P3 = """
WITH dim AS (SELECT series_id, max(step_ns) AS step FROM series_dim JOIN metric_defs USING (metric) WHERE kind = 'gauge' GROUP BY 1),
slots AS (SELECT s.series_id, step, ts_ns // step AS slot, count(DISTINCT (ts_ns, value)) AS n FROM samples s JOIN dim USING (series_id)
  WHERE ts_ns IS NOT NULL AND step > 0 AND value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
runs AS (SELECT *, lag(slot) OVER (PARTITION BY series_id ORDER BY slot) AS prev FROM slots)
"""

_DAY = "strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS day_utc"

_GRID = """
WITH dim AS (SELECT series_id, max(step_ns) AS step, any_value(lo) AS lo, any_value(hi) AS hi FROM series_dim JOIN metric_defs USING (metric) WHERE kind = 'gauge' GROUP BY 1),
pts AS (SELECT DISTINCT s.series_id, step, ts_ns, ts_ns // step AS slot, (ts_ns - ts_ns // step * step)::DOUBLE / step - 0.5 AS o,
    CASE WHEN isinf(value) OR coalesce(value < lo, false) OR coalesce(value > hi, false) THEN NULL ELSE value END AS y
  FROM samples s JOIN dim USING (series_id) WHERE ts_ns IS NOT NULL AND step > 0 AND value IS NOT NULL AND NOT isnan(value)),
own AS (SELECT series_id, step, slot, count(*) AS n FROM pts GROUP BY ALL),
runs AS (SELECT *, lag(slot) OVER (PARTITION BY series_id ORDER BY slot) AS prev FROM own),
slots AS (SELECT series_id, step, slot, n FROM own UNION ALL
  SELECT series_id, step, unnest(generate_series(prev + 1, slot - 1)), 0 FROM runs WHERE slot - prev > 1 AND (slot - prev - 1) * step <= 864000000000000),
cells AS (SELECT series_id, slot + k AS slot, o - k AS d, 1 - (o - k) / 1.5 * ((o - k) / 1.5) AS w, y FROM pts, (SELECT unnest([-1, 0, 1]) AS k) WHERE y IS NOT NULL AND abs(o - k) < 1.5),
m AS (SELECT series_id, slot, sum(w) AS w, sum(w * w) AS ww, sum(w * d) AS wd, sum(w * d * d) AS wdd, sum(w * y) AS wy, sum(w * d * y) AS wdy, coalesce(sum(w) FILTER (d < 0), 0) AS wb, coalesce(sum(w) FILTER (d > 0), 0) AS wa FROM cells GROUP BY ALL),
j AS (SELECT series_id, slot * step AS slot_ns, n, m.*, CASE WHEN w > 0 THEN w * w / ww ELSE 0 END AS support, n > 0 OR (w > 0 AND w * w / ww >= 1.5 AND wb > 0 AND wa > 0) AS enough FROM slots LEFT JOIN m USING (series_id, slot))
SELECT series_id, slot_ns, CASE WHEN enough AND w > 0 THEN round(CASE WHEN w * wdd - wd * wd > 0.01 * w * w THEN (wdd * wy - wd * wdy) / (w * wdd - wd * wd) ELSE wy / w END, 3) END AS value,
  CAST(n AS BIGINT) AS n_readings, round(coalesce(support, 0), 6) AS support, n = 0 AS missing, coalesce(n = 0 AND enough AND w > 0, false) AS filled FROM j
"""

ORACLE: dict[str, str] = {
    "p1_found": _P1_POINTS + "SELECT DISTINCT id, hour_ns FROM k WHERE lateness = 1",
    "p1_hourly": _P1_POINTS + _HOURS,
    "p1_stored": _P1_POINTS + _HOURS,
    "p3_check": _GRID,
    "p5_impossible": "WITH dim AS (SELECT series_id, any_value(lo) AS lo, any_value(hi) AS hi FROM series_dim JOIN metric_defs USING (metric) WHERE kind = 'gauge' GROUP BY 1) SELECT DISTINCT s.series_id, ts_ns, value FROM samples s JOIN dim USING (series_id) WHERE ts_ns IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND (isinf(value) OR coalesce(value < lo, false) OR coalesce(value > hi, false))",
    "p3_found": _P3 + "SELECT series_id, unnest(generate_series(prev + 1, slot - 1)) * step AS slot_ns FROM runs WHERE slot - prev > 1 AND (slot - prev - 1) * step <= 864000000000000",
    "p4_found": _DAILY.format(join="JOIN (SELECT DISTINCT series_id FROM series_dim JOIN metric_defs USING (metric) WHERE kind = 'counter') USING (series_id)")
    + f"SELECT series_id, {_DAY} FROM t WHERE (10 * t7 > 7 * t30 OR 300 * t7 < 7 * t30) AND day >= first_day + 29 AND day <= last_day",
    "p4_trailing": _DAILY.format(join="") + f"SELECT series_id, {_DAY}, {', '.join(_TIDY.format(x, c) for x, c in (('t7', 't7'), ('t30', 't30'), ('t7 / 7', 'avg7'), ('t30 / 30', 'avg30')))} FROM t",
}
