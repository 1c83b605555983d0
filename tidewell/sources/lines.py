"""Line formats as column expressions: the telnet ``put`` format and the bulk row format.

``put metric time value tag=value …``: times below 0xFFFFFFFF are seconds, others nanoseconds, and what is
no number is read as ISO. Other verbs are ignored; an unknown verb or a bad ``put`` gives ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.names import canonical
from tidewell.functions.timefmt import parse_column

# Verbs that take no part in loading, with the fixed replies of two of them.
IGNORED = ("rollup", "hist", "help", "dropcaches", "stats", "version")
REPLIES = {"stats": "tidewell.rpcs 0 0 type=none\n", "version": "tidewell telnet endpoint\n"}
SECONDS_BELOW = 0xFFFFFFFF


def _put_time(text: Column) -> Column:
    n = F.when(text.rlike(r"^\d{1,18}$|^[1-8]\d{18}$"), text.try_cast("bigint"))
    return F.when(n > 0, F.when(n < SECONDS_BELOW, n * 1_000_000_000).otherwise(n)).otherwise(parse_column(text))


def parse_put(lines: DataFrame, line: str = "value", canonical_names: bool = True) -> DataFrame:
    """series, ts_ns, value, error of each line; blank lines and ignored verbs give no row.

    Without ``canonical_names`` names stay as sent, for a consumer that parses each distinct name once.
    """
    text = F.trim(F.regexp_replace(F.col(line), r"[\r\n]+$", ""))
    word = F.split(text, r"(?<!\\) +")
    rows = lines.select(text.alias("_t"), word.alias("_w")).filter(F.col("_t").isNotNull() & (F.col("_t") != "")).withColumn("_verb", F.get("_w", F.lit(0)))
    rows = rows.filter(~F.col("_verb").isin(*IGNORED))
    tags = F.array_join(F.slice("_w", F.lit(5), F.greatest(F.size("_w") - 4, F.lit(0))), " ")
    sent = F.concat_ws(" ", F.get("_w", F.lit(1)), tags)
    parsed = F.struct(
        F.col("_verb"),
        (canonical(sent) if canonical_names else sent).alias("series"),
        _put_time(F.get("_w", F.lit(2))).alias("ts_ns"),
        F.get("_w", F.lit(3)).try_cast("double").alias("value"),
    )
    # a generator of one row keeps the optimizer from copying the parsing into each use of its results
    made = rows.select(F.inline(F.array(parsed)))
    error = (
        F.when(F.col("_verb") != "put", F.lit("unknown verb"))
        .when(F.col("series").isNull(), F.lit("put needs a series name with tags"))
        .when(F.col("ts_ns").isNull(), F.lit("put needs a time"))
        .when(F.col("value").isNull(), F.lit("put needs a value"))
    )
    bad = error.isNotNull()
    return made.select(*(F.when(~bad, F.col(c)).alias(c) for c in ("series", "ts_ns", "value")), error.alias("error"))


def parse_bulk(rows: DataFrame, name: str = "name", ts: str = "ts_ns", values: str = "values") -> DataFrame:
    """series, ts_ns, value of compound rows: ``m1|m2 tags`` with an array of as many values.

    Rows with a null or bad name or another number of values give no rows; a null value is left out.
    """
    whole = rows.select(F.inline(F.array(F.struct(canonical(F.col(name)).alias("_n"), F.col(ts).alias("ts_ns"), F.col(values).alias("_v")))))
    # the metrics end at the first space that isn't escaped
    head = F.get(F.split("_n", r"(?<!\\) ", 2), F.lit(0))
    parts = whole.filter("_n is not null").select(F.split(head, r"\|").alias("_m"), F.substring("_n", F.length(head) + 1, F.length("_n")).alias("_tags"), "ts_ns", "_v").filter(F.size("_m") == F.size("_v"))
    each = parts.select("_tags", "ts_ns", F.explode(F.arrays_zip("_m", "_v")).alias("z")).filter("z._m <> ''")
    out = each.select(F.concat(F.col("z._m"), F.col("_tags")).alias("series"), "ts_ns", F.col("z._v").cast("double").alias("value"))
    return out.filter("series is not null and ts_ns is not null and value is not null")


def with_dictionary(frames: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Replace ids of frames (id, …) by the names of a dictionary (id, name); unknown ids give no rows."""
    from tidewell.operators.common import attach_dimension

    one = dictionary.filter("id is not null and name is not null").groupBy("id").agg(F.min("name").alias("name"))
    return attach_dimension(frames, one, "id", ["ts_ns"]).drop("id")
