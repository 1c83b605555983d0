"""Irregular readings onto a regular grid by kernel-weighted local linear regression.

Each source has a step; slot k covers [k*step, (k+1)*step). The value of a slot is the local linear
fit at its middle with the compact Epanechnikov kernel, w = 1 - (d/h)^2 for distances d below the
bandwidth h (in steps). A reading therefore matters to a fixed number of slots only: it is sent to
those slots as a row of moments, and moments add up in a hash aggregation with partial sums on the map
side. No source is ever gathered in one task.

Slots without a reading are found from neighbouring readings inside blocks of ``BLOCK`` slots of a
source. What happens between blocks is settled on a table with one row per non-empty block.

Defined cases: readings with null key, time, step or with null or NaN value are absent; repeated rows
(key, time, value) count once; infinite values are readings but carry no weight, so a slot with
nothing else has a null value; a step that is not positive gives no slots; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.common import DAY_NS, div, floor_to, present

#: Slots per block of a source, and of a part of a gap.
BLOCK, STRETCH = 512, 4096
#: Runs of empty slots that last longer than this hold no slots: the source was out of service.
OUTAGE_NS = 10 * DAY_NS
#: Kernel bandwidth in steps.
BANDWIDTH = 1.5
#: Least effective support, (sum w)^2 / sum w^2, at which a slot without a reading gets a value.
MIN_SUPPORT = 1.5
#: Least weighted variance of the distances, in steps squared, at which a line is fitted instead of a mean: any, and for two-sided grids.
ANY_SPREAD, SPREAD = 1e-6, 0.01


def readings(samples: DataFrame, key: str = "series_id", ts: str = "ts_ns", value: str = "value", step: str = "step_ns") -> DataFrame:
    """key, step, block, slot, ts, value of distinct readings, partitioned by (key, block): the one shuffle of raw rows."""
    src = samples.filter(F.col(key).isNotNull() & F.col(ts).isNotNull() & (F.col(step) > 0) & present(value))
    src = src.select(F.col(key).alias("key"), F.col(step).alias("step"), F.col(ts).alias("ts"), F.col(value).alias("value"), floor_to(F.col(ts), F.col(step)).alias("slot"))
    src = src.withColumn("block", floor_to(F.col("slot"), BLOCK))
    return src.repartition("key", "block").dropDuplicates(["key", "block", "ts", "value"])


def last_before(samples: DataFrame, key: str = "series_id", ts: str = "ts_ns", value: str = "value", step: str = "step_ns") -> DataFrame:
    """key, block, before: the last slot with a reading in earlier blocks, if an outage hasn't passed since then.

    One row per block goes into a window over (key, long period). Each row also takes part in the next
    period, which is long enough that whatever lies further back is out of service.
    """
    src = samples.filter(F.col(key).isNotNull() & F.col(ts).isNotNull() & (F.col(step) > 0) & present(value))
    src = src.select(F.col(key).alias("key"), F.col(step).alias("step"), floor_to(F.col(ts), F.col(step)).alias("slot")).withColumn("block", floor_to(F.col("slot"), BLOCK))
    edges = src.groupBy("key", "step", "block").agg(F.max("slot").alias("last"))
    edges = edges.withColumn("period", floor_to(F.col("block") * BLOCK, div(F.lit(2 * OUTAGE_NS), F.col("step")) + 2 * BLOCK))
    edges = edges.withColumn("ahead", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", F.col("period") + F.col("ahead"))
    w = Window.partitionBy("key", "at").orderBy("block")
    return edges.withColumn("before", F.lag("last").over(w)).filter("ahead = 0").select("key", "block", "before")


def with_previous(samples: DataFrame) -> DataFrame:
    """Distinct readings with ``prev``, the slot of the reading before, null where there is none within reach."""
    w = Window.partitionBy("key", "block").orderBy("ts")
    rows = readings(samples).withColumn("prev", F.lag("slot").over(w))
    return rows.join(last_before(samples), ["key", "block"], "left").withColumn("prev", F.coalesce("prev", "before")).drop("before")


def _stretches(outage_ns: int) -> Column:
    """The empty slots right before a reading's slot as stretches (from, to) of bounded length; none after an outage."""
    missing = F.col("slot") - F.col("prev") - 1
    starts = F.when((missing > 0) & (missing <= div(F.lit(outage_ns), F.col("step"))), F.sequence(F.col("prev") + 1, F.col("slot") - 1, F.lit(STRETCH).cast("bigint")))
    return F.transform(F.coalesce(starts, F.array().cast("array<bigint>")), lambda a: F.struct(a.alias("from"), F.least(a + (STRETCH - 1), F.col("slot") - 1).alias("to")))


def empty_slots(samples: DataFrame, outage_ns: int = OUTAGE_NS) -> DataFrame:
    """key, step, slot of each slot without a reading between two readings, outages left out."""
    gaps = with_previous(samples).select("key", "step", F.explode(_stretches(outage_ns)).alias("g"))
    return gaps.select("key", "step", F.explode(F.sequence("g.from", "g.to")).alias("slot"))


def grid(samples: DataFrame, bandwidth: float = BANDWIDTH, min_support: float = MIN_SUPPORT, outage_ns: int = OUTAGE_NS, two_sided: bool = False) -> DataFrame:
    """key, slot_ns, value, n_readings, support, missing, filled: one row per slot in service.

    ``samples`` needs series_id, ts_ns, value, step_ns. ``value`` is the fit where a slot has a reading
    or enough support (``filled``), else null. ``missing`` marks slots without a reading. ``two_sided``: an
    empty slot also needs readings on both sides, and readings close together give their mean, not a line.
    """
    if not bandwidth > 0.5:
        raise ValueError("the bandwidth must exceed half a step, else a slot can miss its own readings")
    reach = math.ceil(bandwidth - 0.5)
    zero, moments = F.lit(0.0), ("w", "wb", "wa", "ww", "wd", "wdd", "wy", "wdy")
    # plain columns after a narrow generator, so that moments nobody asks for are never computed
    offset = (F.col("ts") - F.col("slot") * F.col("step")).cast("double") / F.col("step") - 0.5
    cells = readings(samples).select("key", "step", "slot", "value", offset.alias("offset"), F.explode(F.array(*(F.lit(k) for k in range(-reach, reach + 1)))).alias("k"))
    d, solid = F.col("offset") - F.col("k"), F.col("value").isin(float("inf"), float("-inf"))
    weight = F.when(~solid & (F.abs(d) < bandwidth), 1 - (d / bandwidth) * (d / bandwidth)).otherwise(zero)
    cells = cells.select("key", "step", (F.col("slot") + F.col("k")).alias("slot"), (F.col("k") == 0).cast("int").alias("n"), F.lit(0).alias("gap"), weight.alias("w"), d.alias("d"), F.when(solid, zero).otherwise(F.col("value")).alias("y"))
    w, d = F.col("w"), F.col("d")
    made = {"w": w, "wb": F.when(d < 0, w).otherwise(zero), "wa": F.when(d > 0, w).otherwise(zero), "ww": w * w, "wd": w * d, "wdd": w * d * d, "wy": w * F.col("y"), "wdy": w * d * F.col("y")}
    cells = cells.select("key", "step", "slot", "n", "gap", *(made[c].alias(c) for c in moments))
    gaps = empty_slots(samples, outage_ns).select("key", "step", "slot", F.lit(0).alias("n"), F.lit(1).alias("gap"), *(zero.alias(c) for c in moments))
    parts = cells.unionByName(gaps)
    m = parts.groupBy("key", "step", "slot").agg(F.sum("n").alias("n"), F.max("gap").alias("gap"), *(F.sum(c).alias(c) for c in moments))
    m = m.filter("n > 0 or gap > 0")
    det = F.col("w") * F.col("wdd") - F.col("wd") * F.col("wd")
    line = (F.col("wdd") * F.col("wy") - F.col("wd") * F.col("wdy")) / det
    fit = F.when(F.col("w") <= 0, None).when(det > (SPREAD if two_sided else ANY_SPREAD) * F.col("w") * F.col("w"), line).otherwise(F.col("wy") / F.col("w"))
    support = F.when(F.col("ww") > 0, F.col("w") * F.col("w") / F.col("ww")).otherwise(zero)
    filling = support >= min_support
    if two_sided:
        filling &= (F.col("wb") > 0) & (F.col("wa") > 0)
    enough = (F.col("n") > 0) | filling
    return m.select(
        "key",
        (F.col("slot") * F.col("step")).alias("slot_ns"),
        F.when(enough, fit).alias("value"),
        F.col("n").alias("n_readings"),
        support.alias("support"),
        (F.col("n") == 0).alias("missing"),
        ((F.col("n") == 0) & enough & (F.col("w") > 0)).alias("filled"),
    )


def found_empty(grid_rows: DataFrame) -> DataFrame:
    """key, slot_ns of the slots that the grid marks as missing."""
    return grid_rows.filter("missing").select("key", "slot_ns")
