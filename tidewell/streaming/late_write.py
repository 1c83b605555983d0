"""The append-only rule on a stream: state is the last accepted time of each series.

A row is accepted if its time lies after all times before it in its series, so a running maximum decides.
Within a micro-batch it comes from the batch form, which splits large series; across micro-batches only the
latest time per series is state, kept in a folder like a store's. Python sees no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import late_write
from tidewell.operators.common import attach_dimension
from tidewell.session import scope


class LateRule:
    """For ``foreachBatch``: hands each micro-batch, with ``accepted``, to a sink.

    ``path`` is a folder for the last times. Rows have series, ts_ns, seq (order of arrival) and whatever
    else. A repeated batch is judged as the first time. Rows with null series, time or order are rejected.
    """

    def __init__(self, path: str, sink: Callable[[DataFrame, int], None]) -> None:
        self.path, self.sink = path, sink

    def _before(self, like: DataFrame, batch: int) -> DataFrame | None:
        spark = like.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return None
        names = sorted((int(x.getPath().getName()[6:]) for x in fs.listStatus(at) if x.getPath().getName().startswith("batch=")), reverse=True)
        older = [n for n in names if n < batch]
        for n in older[1:]:  # a repeated batch needs the latest of them
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, f"batch={n}"), True)
        return spark.read.parquet(f"{self.path}/batch={older[0]}") if older else None

    def __call__(self, rows: DataFrame, batch: int) -> None:
        last = self._before(rows, batch)
        with scope() as keep:
            judged = late_write.mark_late(rows)
            if last is not None:
                mine = keep(last.join(rows.select("series").distinct(), "series", "left_semi"))
                judged = attach_dimension(judged, mine, "series", ["seq"], "left")
                judged = judged.withColumn("accepted", F.col("accepted") & (F.col("last").isNull() | (F.col("ts_ns") > F.col("last")))).drop("last")
            judged = keep(judged)
            tops = judged.filter("accepted").groupBy("series").agg(F.max("ts_ns").alias("last"))
            (tops if last is None else last.unionByName(tops).groupBy("series").agg(F.max("last").alias("last"))).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
            self.sink(judged, batch)
