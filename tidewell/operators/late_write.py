"""The append-only rule: a row is accepted if its time lies after all times accepted before in its series.

The running maximum of a series is put together from maxima of blocks of arrivals, so that no window
holds a whole series. Defined cases: rows with null key, time or arrival are rejected; equal times are
late; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.common import floor_to

#: Arrivals per block, of all series together.
BLOCK = 1_000_000


def mark_late(rows: DataFrame, key: str = "series", ts: str = "ts_ns", arrival: str = "seq", block: int = BLOCK) -> DataFrame:
    """Add ``accepted``."""
    whole = F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(arrival).isNotNull()
    src = rows.withColumn("_block", floor_to(F.col(arrival), block))
    tops = src.filter(whole).groupBy(key, "_block").agg(F.max(ts).alias("_top"))
    tops = tops.withColumn("_before", F.max("_top").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    w = Window.partitionBy(key, "_block").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    out = src.withColumn("_near", F.max(F.when(whole, F.col(ts))).over(w)).join(tops, [key, "_block"], "left")
    last = F.greatest("_near", "_before")
    return out.withColumn("accepted", whole & (last.isNull() | (F.col(ts) > last))).drop("_block", "_near", "_before")
