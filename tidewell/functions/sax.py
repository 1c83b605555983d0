"""Symbolic words of sliding windows: z-normalised values become letters by equal shares of the normal curve."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidewell.errors import QueryError
from tidewell.functions.ordered import along

#: A window whose deviation is below this is only centred.
FLAT = 1e-10


def cut_points(letters: int) -> list[float]:
    """Borders between letters: quantiles of the normal distribution."""
    return [0.0 if 2 * i == letters else NormalDist().inv_cdf(i / letters) for i in range(1, letters)]


def letter(z: Column, letters: int) -> Column:
    out = F.lit(chr(ord("a") + letters - 1))
    for i, cut in reversed(list(enumerate(cut_points(letters)))):
        out = F.when(z < cut, F.lit(chr(ord("a") + i))).otherwise(out)
    return out


def words(rows: DataFrame, alphabet: int, width: int, key: str = "series", backward: bool = False, **cut: int) -> DataFrame:
    """series, ts_ns, word of each window of ``width`` readings, without words equal to the one before."""
    if not 1 <= alphabet <= 20:
        raise QueryError("sax: alphabet_size lies outside 1 to 20")
    if width < 4:
        raise QueryError("sax: window_width is below 4")

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        frame = w.rowsBetween(-(width - 1), 0)
        mean, dev = F.avg("value").over(frame), F.stddev_samp("value").over(frame)
        df = df.withColumn("_m", mean).withColumn("_d", dev).withColumn("_v", F.collect_list("value").over(frame))
        scale = F.when(F.col("_d") < FLAT, F.lit(1.0)).otherwise(F.col("_d"))
        text = F.array_join(F.transform("_v", lambda v: letter((v - F.col("_m")) / scale, alphabet)), "")
        df = df.withColumn("word", F.when(F.size("_v") == width, text))
        return df.withColumn("_same", F.col("word").eqNullSafe(F.lag("word").over(w)))

    out = along(rows.filter("value is not null"), key, compute, width, backward, **cut)
    return out.filter("word is not null and not _same").select(key, "ts_ns", "word")
