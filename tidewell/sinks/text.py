"""Results as text: CSV lines and RESP frames, and writers of both.

Doubles print with up to 17 significant digits, as C's %.17g does; this is the one thing built-in
functions can't format, so an Arrow function does it column-wise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewell.functions.timefmt import iso_column
from tidewell.shipping import ship

ship(__name__)


@F.pandas_udf(StringType())
def g17(values: pd.Series) -> pd.Series:
    """%.17g of doubles; nulls must be masked by the caller, as pandas shows them as NaN."""
    return values.map(lambda v: "%.17g" % v)


def _stamp(iso: bool) -> Column:
    return iso_column(F.col("ts_ns")) if iso else F.concat(F.lit("ts="), F.col("ts_ns").cast("string"))


def _text(c: str, kind: str) -> Column:
    return F.when(F.col(c).isNotNull(), g17(F.col(c))) if kind == "double" else F.col(c).cast("string")


def _fields(df: DataFrame) -> list[tuple[str, str]]:
    return [(c, k) for c, k in df.dtypes if c not in ("series", "ts_ns")]


def csv_lines(df: DataFrame, iso: bool = True) -> DataFrame:
    """``line``: series,timestamp,value[,value…]; a missing element is an empty field."""
    parts = [F.coalesce(_text(c, k), F.lit("")) for c, k in _fields(df)]
    head = [F.col("series")] + ([_stamp(iso)] if "ts_ns" in df.columns else [])
    return df.select(F.concat_ws(",", *head, *parts).alias("line"))


def resp_frames(df: DataFrame, iso: bool = True) -> DataFrame:
    """``line``: the frame of a row with \\r\\n after each token; several values are an array, a missing one is $-1."""
    fields, end = _fields(df), "\r\n"
    parts = [F.coalesce(F.concat(F.lit("+"), _text(c, k)), F.lit("$-1")) for c, k in fields]
    body = [F.lit(f"*{len(fields)}"), *parts] if len(fields) > 1 else parts
    head = [F.concat(F.lit("+"), F.col("series"))] + ([F.concat(F.lit("+"), _stamp(iso))] if "ts_ns" in df.columns else [])
    return df.select(F.concat(F.concat_ws(end, *head, *body), F.lit(end)).alias("line"))


def lines(df: DataFrame, form: str = "resp", iso: bool = True) -> DataFrame:
    """A result in a format of the output clause."""
    return csv_lines(df, iso) if form == "csv" else resp_frames(df, iso)


def write_text(df: DataFrame, path: str, form: str = "resp", iso: bool = True) -> None:
    """Write the lines of a result as text files, one per partition."""
    out = lines(df, form, iso)
    if form == "csv":
        out.write.text(path)
    else:
        out.select(F.regexp_replace("line", "\r\n$", "").alias("value")).write.option("lineSep", "\r\n").text(path)
