"""Loading a stream: canonical names, new series into the dimension, the append-only rule, files by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.names import canonical, metric_of
from tidewell.operators.common import DAY_NS, attach_dimension, present
from tidewell.operators.late_write import mark_late
from tidewell.session import scope

#: Parts of the folder of a store.
SAMPLES, EVENTS, SERIES, LAST, REJECTED = "samples", "events", "series", "last", "rejected"
SCHEMAS = {
    SAMPLES: "series string, ts_ns bigint, value double, batch bigint, day bigint",
    EVENTS: "series string, ts_ns bigint, body string, batch bigint, day bigint",
    SERIES: "series_id bigint, series string, metric string, batch bigint",
    LAST: "series string, last bigint, batch bigint",
    REJECTED: "series string, ts_ns bigint, value double, body string, reason string, batch bigint",
}


def _number(series: str) -> Column:
    """The id of a series: a hash of its name, negative for events."""
    return F.when(F.col(series).startswith("!"), -F.abs(F.xxhash64(series))).otherwise(F.xxhash64(series))


class Store:
    """A folder with samples and events by day, the dimension of series, their last times, and rejected rows with a reason.

    ``write`` takes a batch with series, ts_ns, value, body and seq (order of arrival). A batch has a
    number; writing it again replaces it, so the store is safe under retries of ``foreachBatch``. What was
    stored before isn't read: the last times of series after each of the last two batches are all that a
    batch is judged by.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")

    def _read(self, name: str) -> DataFrame | None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}") if there else None

    def _put(self, df: DataFrame, name: str, batch: int, *by: str) -> None:
        # few files per day, large days split
        df = df.hint("rebalance", *by) if by else df
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").partitionBy("batch", *by).parquet(f"{self.path}/{name}")

    def _before(self, batch: int) -> DataFrame | None:
        """Last times of all series after the latest batch before this one."""
        old = self._read(LAST)
        at = None if old is None else old.filter(F.col("batch") < batch).agg(F.max("batch")).first()[0]
        return None if at is None else old.filter(F.col("batch") == at).select("series", "last")

    def _forget(self, before: int) -> None:
        """Remove last times that neither the next batch nor a repeated one needs."""
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = fs.Path(f"{self.path}/{LAST}")
        there = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        numbers = sorted(int(x.getPath().getName()[6:]) for x in there.listStatus(root) if x.getPath().getName().startswith("batch="))
        for n in [n for n in numbers if n < before][:-1]:
            there.delete(fs.Path(root, f"batch={n}"), True)

    def write(self, rows: DataFrame, batch: int) -> None:
        rows = rows.select(F.col("series").alias("sent"), "ts_ns", "value", "body", "seq")
        with scope() as keep:
            last = self._before(batch)
            # names are parsed once per name, not once per row; the generator of one row keeps the optimizer
            # from inferring a filter on the parsed name for every row
            names = rows.select("sent").filter("sent is not null").distinct().select(F.inline(F.array(F.struct("sent", canonical(F.col("sent")).alias("series")))))
            names = keep(names.join(last, "series", "left") if last is not None else names.withColumn("last", F.lit(None).cast("bigint")))
            src = attach_dimension(rows, names, "sent", ["seq"], "left").withColumn("event", F.col("series").startswith("!"))
            filled = F.when(F.col("event"), F.col("body").isNotNull()).otherwise(present("value"))
            judged = mark_late(src.withColumn("_key", F.when(filled, F.col("series"))), "_key")
            late = ~F.col("accepted") | F.coalesce(F.col("ts_ns") <= F.col("last"), F.lit(False))
            reason = F.when(F.col("series").isNull(), "bad name").when(F.col("ts_ns").isNull(), "no time").when(F.col("_key").isNull(), "no value").when(late, "late write")
            judged = judged.withColumn("reason", reason).withColumn("day", F.call_function("div", F.col("ts_ns"), F.lit(DAY_NS)))
            judged = keep(judged.drop("_key", "accepted", "last"))
            good = judged.filter("reason is null")
            tops = keep(good.groupBy("series").agg(F.max("ts_ns").alias("last")))
            self._put(good.filter("not event").select("series", "ts_ns", "value", "day"), SAMPLES, batch, "day")
            self._put(good.filter("event").select("series", "ts_ns", "body", "day"), EVENTS, batch, "day")
            self._put(judged.filter("reason is not null").select(F.coalesce("series", "sent").alias("series"), "ts_ns", "value", "body", "reason"), REJECTED, batch)
            fresh = tops.join(names.filter("last is null").select("series").distinct(), "series", "left_semi")
            self._add_series(fresh.select(_number("series").alias("series_id"), "series", metric_of(F.col("series")).alias("metric")), batch)
            self._put(tops if last is None else last.unionByName(tops).groupBy("series").agg(F.max("last").alias("last")), LAST, batch)
            self._forget(batch)

    def _add_series(self, fresh: DataFrame, batch: int) -> None:
        """Add new series. Ids are hashes of names; two names with one id are an error, not one series."""
        self._put(fresh, SERIES, batch)
        known = self._read(SERIES).filter(F.col("batch") <= batch)
        mine = known.filter(F.col("batch") == batch).select("series_id")
        twice = known.join(mine, "series_id", "left_semi").groupBy("series_id").agg(F.count_distinct("series").alias("n")).filter("n > 1")
        if clash := twice.first():
            raise ValueError(f"two names of series have the id {clash.series_id}")

    def rejected(self) -> DataFrame | None:
        return self._read(REJECTED)

    def catalog(self):
        """The store as a catalog for queries."""
        from tidewell.plans.catalog import Catalog, dimension

        ids = self._read(SERIES)
        if ids is None:
            raise ValueError("the store is empty")
        known, parts = ids.select("series_id", "series"), {}
        for kind, col in ((SAMPLES, "value"), (EVENTS, "body")):
            df = self._read(kind)
            df = self.spark.createDataFrame([], f"series string, ts_ns bigint, {col} {'double' if col == 'value' else 'string'}") if df is None else df
            parts[kind] = df.select(_number("series").alias("series_id"), "ts_ns", col)
        return Catalog(parts[SAMPLES], parts[EVENTS], dimension(known))
