"""Aggregates per period of happening, corrected by late records until a cut-off.

State is a table of mergeable partial aggregates, one row per (key, period, arrival batch). Reading
combines the batches; merging adds a batch. A point that arrives after its period has closed is
refused before it reaches the state, so a closed period never changes.

Defined cases: null keys, times, arrivals, and null or NaN values are ignored; infinite values count;
identical points (key, time, value) count once, with their earliest arrival; keys without a cut-off
are ignored; an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.common import HOUR_NS, attach_dimension, div, floor_to, present

#: Times below these bounds are seconds, milliseconds and microseconds; fixed by the digits of present-day times.
UNIT_BOUNDS = ((100_000_000_000, 1_000_000_000), (100_000_000_000_000, 1_000_000), (100_000_000_000_000_000, 1_000))


def to_ns(ts: Column) -> Column:
    """Bring times of a coarser unit to nanoseconds, told apart by magnitude."""
    out = F.when(F.abs(ts) < UNIT_BOUNDS[0][0], ts * UNIT_BOUNDS[0][1])
    for bound, factor in UNIT_BOUNDS[1:]:
        out = out.when(F.abs(ts) < bound, ts * factor)
    return out.otherwise(ts)


def points(log: DataFrame, period_ns: int = HOUR_NS, key: str = "id", ts: str = "ts_raw", value: str = "value", arrived: str = "arrived_at") -> DataFrame:
    """Distinct points: key, period_ns, ts_ns, value, arrived_us (earliest)."""
    src = log.filter(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(arrived).isNotNull() & present(value))
    src = src.select(F.col(key).alias("key"), to_ns(F.col(ts)).alias("ts_ns"), F.col(value).alias("value"), F.unix_micros(F.col(arrived).cast("timestamp")).alias("arrived_us"))
    out = src.groupBy("key", "ts_ns", "value").agg(F.min("arrived_us").alias("arrived_us"))
    return out.withColumn("period_ns", floor_to(F.col("ts_ns"), period_ns) * period_ns)


def judged(pts: DataFrame, cutoffs: DataFrame, period_ns: int = HOUR_NS) -> DataFrame:
    """Points with ``lateness``: 0 in time, 1 late but accepted, 2 refused as their period has closed.

    ``cutoffs``: one row per key with cutoff_us, the time after a period's end at which it closes.
    A point arriving exactly at the end is late; one arriving exactly at the closing is accepted.
    """
    out = attach_dimension(pts, cutoffs.select("key", "cutoff_us"), "key", ["ts_ns"])
    end_us = div(F.col("period_ns") + period_ns, 1000)
    return out.withColumn("lateness", F.when(F.col("arrived_us") < end_us, 0).when(F.col("arrived_us") <= end_us + F.col("cutoff_us"), 1).otherwise(2)).drop("cutoff_us")


def partials(accepted: DataFrame, batch_us: int = 3_600_000_000) -> DataFrame:
    """Mergeable partial aggregates per key, period and arrival batch."""
    return accepted.filter("lateness < 2").groupBy("key", "period_ns", (F.col("arrived_us") - F.pmod(F.col("arrived_us"), F.lit(batch_us))).alias("batch_us")).agg(
        F.count("*").alias("n"),
        F.sum("value").alias("total"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.sum("lateness").alias("n_late"),
        F.min("arrived_us").alias("first_arrived_us"),
        F.max("arrived_us").alias("last_arrived_us"),
    )


def combine(parts: DataFrame, as_of_us: int | None = None) -> DataFrame:
    """Combine partials on read; with ``as_of_us`` only the batches that had begun by then."""
    if as_of_us is not None:
        parts = parts.filter(F.col("batch_us") <= as_of_us)
    return parts.groupBy("key", "period_ns").agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.sum("n_late").alias("n_late"),
        F.max("last_arrived_us").alias("last_arrived_us"),
        F.count("*").alias("corrections"),
    )


def cutoffs_of(series: DataFrame) -> DataFrame:
    """Closing delay per series from its metric's ``late_cutoff_s``; series without one have no result."""
    return series.filter("late_cutoff_s is not null").select(F.col("series_id").alias("key"), (F.col("late_cutoff_s") * 1_000_000).alias("cutoff_us"))


def hourly(log: DataFrame, series: DataFrame, period_ns: int = HOUR_NS, batch_us: int = 3_600_000_000) -> DataFrame:
    """The partial aggregates of a whole log, made in one pass."""
    return partials(judged(points(log, period_ns), cutoffs_of(series), period_ns), batch_us)
