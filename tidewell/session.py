"""Session builder and the settings the engine relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings override the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Put a foreign session into the state that the operators expect: times in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset, and the session is local, a temporary folder is made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = os.path.join(tempfile.gettempdir(), "tidewell-checkpoints")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: it cuts lineage and survives lost executors.

    The table is removed when the Python process ends.
    """
    out, path = _written(df)
    remove_at_exit(df.sparkSession, path)
    return out


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder that a lazy result still reads when the Python process ends."""
    atexit.register(_remove, spark, path)


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``materialize`` for the length of a block, for loads that go on for weeks: its tables are removed when the block ends."""
    made: list[tuple[SparkSession, str]] = []

    def keep(df: DataFrame) -> DataFrame:
        out, path = _written(df)
        made.append((df.sparkSession, path))
        return out

    try:
        yield keep
    finally:
        for spark, path in made:
            _remove(spark, path)


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = prepare(df.sparkSession)
    path = f"{shared_folder(spark)}/tidewell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone already, and then its folder is none of ours
        pass
