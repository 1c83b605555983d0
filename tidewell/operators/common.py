"""Building blocks shared by the operators: clean readings, size-checked dimension joins, deltas across blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dimension is broadcast only if a count proves that it has no more rows, and no more bytes of text, than this.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Shards of a hot key where a dimension is too large to be broadcast.
SALTS = 32

DAY_NS = 86_400_000_000_000
HOUR_NS = 3_600_000_000_000


def present(value: Column | str) -> Column:
    """True where a value is neither null nor NaN."""
    c = F.col(value) if isinstance(value, str) else value
    return c.isNotNull() & ~F.isnan(c)


def attach_dimension(facts: DataFrame, dim: DataFrame, on: str, spread: Sequence[str], how: str = "inner", max_rows: int = BROADCAST_ROWS, size: tuple[int, int] | None = None) -> DataFrame:
    """Join a dimension that holds one row per key to facts in which one key may hold a third of all rows.

    Up to ``max_rows`` rows and ``BROADCAST_BYTES`` bytes of text, counted before (or known to be at most
    ``size``, rows and bytes), the dimension is broadcast. Beyond that both sides are
    shuffled with a salt: facts get one of ``SALTS`` salts by the hash of ``spread``, the dimension
    gets all of them, so that a hot key is spread over as many tasks.
    """
    if size is None:
        size = measured(dim.limit(max_rows + 1))
    if size[0] <= max_rows and size[1] <= BROADCAST_BYTES:
        return facts.join(F.broadcast(dim), on, how)
    salted = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    facts = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    return facts.join(salted, [on, "_salt"], how).drop("_salt")


def measured(dim: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text of a dimension."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in dim.dtypes if kind == "string"]
    n, text = dim.agg(F.count("*"), F.sum(sum(texts[1:], start=texts[0])) if texts else F.lit(0)).first()
    return n, text or 0


def series_metrics(series_dim: DataFrame, metric_defs: DataFrame) -> DataFrame:
    """One row per series that has a defined metric: series_id, metric, step_ns, kind, lo, hi, late_cutoff_s.

    A series listed more than once with identical contents counts once. The metric definitions are few
    by nature, yet they too are broadcast only after a count.
    """
    one = series_dim.filter("series_id is not null and metric is not null").groupBy("series_id").agg(F.max("metric").alias("metric"), F.max("step_ns").alias("step_ns"))
    defs = metric_defs.filter("metric is not null").dropDuplicates(["metric"]).select("metric", "kind", "lo", "hi", "late_cutoff_s")
    return attach_dimension(one, defs, "metric", ["series_id"])


def div(a: Column, b: Column | int) -> Column:
    """Integer division of longs, towards zero."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def floor_to(ts: Column, step: Column | int) -> Column:
    """Number of the step that holds a time, counted from 1970; right before 1970 too."""
    s = F.lit(step) if isinstance(step, int) else step
    return div(ts - F.pmod(ts, s), s)
