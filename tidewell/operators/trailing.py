"""Totals and averages over trailing days per series, idle days included.

Daily totals are made first, so that a series holds one row per day of its life, however many
readings it has. The total of any window comes from binary doubling: blocks of 1, 2, 4, 8 … days are
sums of two shifted blocks, and a window is a chain of such blocks. Nothing is ever subtracted, so an
infinite or huge value leaves no trace once it has left the window.

Defined cases: null keys, times and values and NaN are ignored; repeated rows (key, time, value) count
once; infinite values make the totals of their windows infinite (or NaN where both signs meet); days
before the first reading count 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.common import DAY_NS, floor_to, present


def daily_totals(samples: DataFrame, key: str = "series_id", ts: str = "ts_ns", value: str = "value") -> DataFrame:
    """key, day (number since 1970), total: one shuffle, on (key, day), does both the removal of repeats and the sums."""
    src = samples.filter(F.col(key).isNotNull() & F.col(ts).isNotNull() & present(value)).select(F.col(key).alias("key"), floor_to(F.col(ts), DAY_NS).alias("day"), F.col(ts).alias("ts"), F.col(value).alias("value"))
    return src.repartition("key", "day").dropDuplicates(["key", "day", "ts", "value"]).groupBy("key", "day").agg(F.sum("value").alias("total"))


def dense_days(totals: DataFrame) -> DataFrame:
    """Add a row with total 0 for each idle day between two active ones."""
    w = Window.partitionBy("key").orderBy("day")
    until = totals.withColumn("to", F.coalesce(F.lead("day").over(w) - 1, F.col("day")))
    return until.withColumn("at", F.explode(F.sequence("day", "to"))).select("key", F.col("at").alias("day"), F.when(F.col("at") == F.col("day"), F.col("total")).otherwise(F.lit(0.0)).alias("total"))


def trailing(totals: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """key, day, first_day, last_day, total, and t<n>, avg<n> of each window, for each day from a key's first to its last."""
    if any(n < 1 for n in windows):
        raise ValueError("a window holds at least one day")
    w = Window.partitionBy("key").orderBy("day")
    whole = Window.partitionBy("key")
    out = dense_days(totals).withColumn("b1", F.col("total"))
    size = 1
    while 2 * size <= max(windows):
        out = out.withColumn(f"b{2 * size}", F.col(f"b{size}") + F.lag(f"b{size}", size, 0.0).over(w))
        size *= 2
    shifted: dict[str, None] = {}
    sums = {}
    for n in windows:
        parts, back = [], 0
        for bit in (1 << k for k in reversed(range(n.bit_length())) if n >> k & 1):
            parts.append((bit, back))
            back += bit
        sums[n] = parts
        shifted |= dict.fromkeys(parts)
    out = out.select("*", *(F.lag(f"b{b}", back, 0.0).over(w).alias(f"b{b}_{back}") for b, back in shifted if back), F.min("day").over(whole).alias("first_day"), F.max("day").over(whole).alias("last_day"))
    cols = []
    for n, parts in sums.items():
        total = sum((F.col(f"b{b}_{back}" if back else f"b{b}") for b, back in parts[1:]), start=F.col(f"b{parts[0][0]}"))
        cols += [total.alias(f"t{n}"), (total / F.lit(float(n))).alias(f"avg{n}")]
    return out.select("key", "day", "first_day", "last_day", "total", *cols)
