"""Standing bucketed aggregation: group-aggregate over a stream, closed by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.errors import QueryError
from tidewell.operators.aggregate import bucket_column


def standing_buckets(stream: DataFrame, step_ns: int, functions: Sequence[str], anchor_ns: int = 0, lateness: str = "1 hour") -> DataFrame:
    """series, ts_ns and a column per function; a bucket comes out once the watermark has passed its end.

    Buckets are anchored at ``anchor_ns``. Spark's windows count microseconds, so step and anchor must be
    whole ones.
    """
    if step_ns % 1000 or anchor_ns % 1000 or step_ns <= 0:
        raise QueryError("a standing query needs a step and an anchor of whole microseconds")
    src = stream.filter("series is not null and ts_ns is not null and value is not null and not isnan(value)")
    src = src.withColumn("at", F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000)))).withWatermark("at", lateness)
    step_us, start_us = step_ns // 1000, (anchor_ns // 1000) % (step_ns // 1000)
    window = F.window("at", f"{step_us} microseconds", startTime=f"{start_us} microseconds")
    out = src.groupBy("series", window.alias("w")).agg(*(bucket_column(f).alias(f) for f in functions))
    return out.select("series", (F.unix_micros("w.start") * 1000).alias("ts_ns"), *functions)
