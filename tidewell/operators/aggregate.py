"""Aggregates over series and over buckets of time, from states that hash aggregation keeps and that can be merged.

A state holds number, sum, least and greatest value, first and last time, and first and last value. The
time of the least or greatest value, and the value at the first or last time where several series share an
output name, can tie; they are looked up among the rows that reach the state's edge, so raw rows are never
sorted. Infinite values are values; NaN and null ones are left out before. Ties of min and max go to the
earliest time, those of first and last (equal times after a projection) to the lower and higher value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.common import div
from tidewell.operators.select import bounded, combined
from tidewell.plans.spec import Query, Range

#: What a state holds beside its keys: least and greatest value and their times, first and last time and their values.
STATE = ("n", "total", "lo", "lo_at", "hi", "hi_at", "t0", "first", "t1", "last")
#: Aggregates whose value is a time, and those that need the time of a value.
_EDGE_TIMES = {"min_timestamp", "max_timestamp"}


def outcome(function: str) -> tuple[Column, Column]:
    """(value, ts_ns) that an aggregate reads from a state."""
    c, none = F.col, F.lit(None).cast("double")
    return {
        "min": (c("lo"), c("lo_at")),
        "max": (c("hi"), c("hi_at")),
        "min_timestamp": (c("lo_at").cast("double"), c("lo_at")),
        "max_timestamp": (c("hi_at").cast("double"), c("hi_at")),
        "sum": (c("total"), c("t1")),
        "count": (c("n").cast("double"), c("t1")),
        "mean": (c("total") / c("n"), c("t1")),
        "last": (c("last"), c("t1")),
        "first": (c("first"), c("t0")),
        "last_timestamp": (none, c("t1")),
        "first_timestamp": (none, c("t0")),
    }[function]


def bucket_outcome(function: str) -> Column:
    """The double that an aggregate contributes to a tuple."""
    value, at = outcome(function)
    return at.cast("double") if function in ("last_timestamp", "first_timestamp") else value


def bucket_column(function: str, value: Column | None = None) -> Column:
    """The same as one aggregate expression over rows with ts_ns and value, for groups in which no time occurs twice. Nulls of ``value`` are ignored."""
    v = F.col("value") if value is None else value
    t = F.when(v.isNotNull(), F.col("ts_ns"))
    least, most = F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), t.alias("t")))), F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), (-t).alias("t"))))
    return {
        "min": F.min(v),
        "max": F.max(v),
        "min_timestamp": least["t"].cast("double"),
        "max_timestamp": (-most["t"]).cast("double"),
        "sum": F.sum(v),
        "count": F.count(v).cast("double"),
        "mean": F.avg(v),
        "last": F.max_by(v, t),
        "first": F.min_by(v, t),
        "last_timestamp": F.max(t).cast("double"),
        "first_timestamp": F.min(t).cast("double"),
    }[function]


def states(rows: DataFrame, keys: Sequence[str], at_edges: bool = True, shared: bool = True) -> DataFrame:
    """A state per key from rows with ts_ns and value.

    ``at_edges``: the times of least and greatest are needed. ``shared``: a time may occur twice under a key.
    Where one of both asks for it, the rows at the edges are looked up in a second pass, else lo_at and
    hi_at are null.
    """
    v, t = F.col("value"), F.col("ts_ns")
    hashed = [F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.min(t).alias("t0"), F.max(t).alias("t1")]
    if not at_edges and not shared:
        none = F.lit(None).cast("bigint")
        return rows.groupBy(*keys).agg(*hashed, F.min_by(v, t).alias("first"), F.max_by(v, t).alias("last")).select(*keys, *(none.alias(c) if c.endswith("_at") else c for c in STATE))
    whole = rows.groupBy(*keys).agg(*hashed)
    k = [F.col(f"w.{c}").alias(c) for c in keys]
    same = reduce(lambda x, y: x & y, (F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in keys))
    edge = (v == F.col("lo")) | (v == F.col("hi")) | (t == F.col("t0")) | (t == F.col("t1"))
    near = rows.alias("r").join(whole.alias("w"), same).select(*k, *(F.col(f"w.{c}") for c in ("n", "total", "lo", "hi", "t0", "t1")), "value", "ts_ns").filter(edge)
    return near.groupBy(*keys).agg(
        *(F.first(c).alias(c) for c in ("n", "total", "lo", "hi", "t0", "t1")),
        F.min(F.when(v == F.col("lo"), t)).alias("lo_at"),
        F.min(F.when(v == F.col("hi"), t)).alias("hi_at"),
        F.min(F.when(t == F.col("t0"), v)).alias("first"),
        F.max(F.when(t == F.col("t1"), v)).alias("last"),
    ).select(*keys, *STATE)


def as_states(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row as a state of its own."""
    v, t = F.col("value"), F.col("ts_ns")
    made = {"n": F.lit(1).cast("bigint"), "total": v, "lo": v, "lo_at": t, "hi": v, "hi_at": t, "t0": t, "first": v, "t1": t, "last": v}
    return rows.select(*keys, *(made[c].alias(c) for c in STATE))


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of the same keys put together; their number is that of periods, not of readings."""
    pair = lambda f, a, b: f(F.struct(a.alias("a"), b.alias("b")))
    c = F.col
    least, most = pair(F.min, c("lo"), c("lo_at")), pair(F.max, c("hi"), -c("hi_at"))
    first, last = pair(F.min, c("t0"), c("first")), pair(F.max, c("t1"), c("last"))
    return parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), least["a"].alias("lo"), least["b"].alias("lo_at"), most["a"].alias("hi"), (-most["b"]).alias("hi_at"),
        first["a"].alias("t0"), first["b"].alias("first"), last["a"].alias("t1"), last["b"].alias("last"),
    )


def bucket_of(ts: Column, r: Range, step: int) -> Column:
    """Label of a time's bucket, anchored at the beginning of the range: downwards for a backward range."""
    if r.backward:
        return F.lit(r.begin) - div(F.lit(r.begin) - ts, step) * step
    return F.lit(r.begin) + div(ts - F.lit(r.begin), step) * step


def per_series(made: DataFrame, q: Query) -> DataFrame:
    """The aggregate statement from states per metric and tag_key: one row per output series and metric."""
    value = ts = head = None
    for metric, function in zip(q.metrics, q.functions, strict=True):
        v, t = outcome(function)
        here = F.col("metric") == metric
        value, ts, head = ((F.when(here, x) if y is None else y.when(here, x)) for x, y in ((v, value), (t, ts), (F.lit(f"{metric}:{function} "), head)))
    return made.select(F.concat(head, F.col("tag_key")).alias("series"), ts.alias("ts_ns"), value.alias("value"))


def per_bucket(made: DataFrame, q: Query) -> DataFrame:
    """The group-aggregate statement from states per metric, tag_key and bucket: a tuple per output series, metric and non-empty bucket."""
    out = made.select("metric", "tag_key", "bucket", *(bucket_outcome(f).alias(f) for f in q.functions))
    if q.filters:
        out = out.filter(combined([bounded(F.col(name), b) for name, b in q.filters], q.any_filter))
    head = F.concat_ws("|", *(F.concat("metric", F.lit(f":{f}")) for f in q.functions))
    return out.select(F.concat(head, F.lit(" "), F.col("tag_key")).alias("series"), F.col("bucket").alias("ts_ns"), *q.functions)


def needs(q: Query) -> dict[str, bool]:
    """What ``states`` has to look up for a query."""
    asked = set(q.functions)
    edges = bool(asked & (_EDGE_TIMES | ({"min", "max"} if q.kind == "aggregate" else set())))
    return {"at_edges": edges, "shared": bool(q.tags) and bool(asked & {"first", "last"})}


def with_bucket(rows: DataFrame, q: Query, ts: str = "ts_ns") -> DataFrame:
    return rows.withColumn("bucket", bucket_of(F.col(ts), q.range, q.step))


def candlesticks(rows: DataFrame, r: Range, step: int) -> DataFrame:
    """Open, high, low and close per series and bucket; ``rows`` needs series, ts_ns, value."""
    out = states(rows.withColumn("bucket", bucket_of(F.col("ts_ns"), r, step)), ["series", "bucket"], at_edges=False)
    return out.select("series", F.col("bucket").alias("ts_ns"), F.col("first").alias("open"), F.col("hi").alias("high"), F.col("lo").alias("low"), F.col("last").alias("close"))


def rollup(rows: DataFrame, step: int, keys: Sequence[str] = ("series",)) -> DataFrame:
    """States per key and epoch-aligned period ``start_ns``, from which any aggregate of whole periods can be read."""
    start = F.col("ts_ns") - F.pmod(F.col("ts_ns"), F.lit(step))
    return states(rows.withColumn("start_ns", start), [*keys, "start_ns"])


def whole_periods(r: Range | None, step: int) -> tuple[int, int] | None:
    """Begin and end of the periods of a roll-up that lie inside a range; None where none does."""
    if r is None:
        return -(1 << 63), (1 << 63) - 1
    a, b = (r.end + 1, r.begin + 1) if r.backward else (r.begin, r.end)
    a, b = -(-a // step) * step, b // step * step
    return (a, b) if a < b else None


def from_rollup(rolled: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Aggregates per key from a roll-up: keys, count, sum, mean, min, max, first, last and the times of the last four."""
    m = merged(rolled, keys)
    return m.select(*keys, F.col("n").cast("double").alias("count"), F.col("total").alias("sum"), (F.col("total") / F.col("n")).alias("mean"), F.col("lo").alias("min"), F.col("hi").alias("max"), "first", "last", F.col("lo_at").alias("min_ts"), F.col("hi_at").alias("max_ts"), F.col("t0").alias("first_ts"), F.col("t1").alias("last_ts"))
