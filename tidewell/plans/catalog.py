"""What queries run on: readings, events, and the dimension of series.

Readings and events hold only the id of their series; names and tags live in the dimension, one row per
series, and are joined in after a query has narrowed both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import names
from tidewell.operators.aggregate import rollup
from tidewell.operators.common import present
from tidewell.plans.spec import Range
from tidewell.session import materialize
from tidewell.sources.tables import table

#: Rows of some metrics in a range; a source may return more than that, never less.
Scan = Callable[[Range | None, tuple[str, ...]], DataFrame]


@dataclass(frozen=True)
class Rollup:
    """States (see ``operators.aggregate``) per series_id and period ``start_ns`` of ``step`` nanoseconds since 1970."""

    states: DataFrame
    step: int


@dataclass(frozen=True)
class Catalog:
    """samples: series_id, ts_ns, value; events: series_id, ts_ns, body; series: series_id, series, metric, tags.

    ``prune`` and ``prune_events`` give narrower readings than the whole tables where a source knows how
    to skip data by range or metric. ``repeats``: rows may be repeated and count once. With a ``rollup`` the
    aggregates of whole periods are read from it.
    """

    samples: DataFrame
    events: DataFrame
    series: DataFrame
    prune: Scan | None = None
    prune_events: Scan | None = None
    repeats: bool = False
    rollup: Rollup | None = None

    def scan(self, r: Range | None, metrics: tuple[str, ...]) -> DataFrame:
        return self.prune(r, metrics) if self.prune else self.samples

    def scan_events(self, r: Range | None, metrics: tuple[str, ...]) -> DataFrame:
        return self.prune_events(r, metrics) if self.prune_events else self.events


def rolled_up(cat: Catalog, step: int) -> Catalog:
    """The catalog with a roll-up of its samples, written to the shared folder."""
    rows = cat.samples.dropDuplicates(["series_id", "ts_ns", "value"]) if cat.repeats else cat.samples
    return replace(cat, rollup=Rollup(materialize(rollup(rows, step, ["series_id"])), step))


def dimension(series_names: DataFrame, series_id: str = "series_id", series: str = "series") -> DataFrame:
    """A dimension from ids and canonical names; repeats are dropped, bad names left out."""
    one = series_names.filter(F.col(series_id).isNotNull() & F.col(series).isNotNull()).groupBy(F.col(series_id).alias("series_id")).agg(F.min(series).alias("series"))
    # a generator of one row keeps the optimizer from parsing a name again for each use
    return one.select("series_id", "series", F.inline(F.array_compact(F.array(names.parts_of(F.col("series"))))))


def domain(spark: SparkSession, sf: str) -> Catalog:
    """The project's own tables. Rows without a value or body are absent, repeated rows count once."""
    samples = table(spark, sf, "samples").filter(F.col("series_id").isNotNull() & F.col("ts_ns").isNotNull() & present("value"))
    events = table(spark, sf, "series_events").filter("series_id is not null and ts_ns is not null and body is not null")
    return Catalog(samples.select("series_id", "ts_ns", "value"), events.select("series_id", "ts_ns", "body"), materialize(dimension(table(spark, sf, "series_dim"))), repeats=True)


def _literal(ns: int) -> Column:
    """A time without zone, in whole microseconds below."""
    return F.timestamp_micros(F.lit(ns // 1000)).cast("timestamp_ntz")


def clicks(spark: SparkSession, sf: str) -> Catalog:
    """The generic ``events`` table as series.

    Metrics: the event types with tags cohort and user; ``ev.value`` and ``ev.k`` with tags type and user,
    which share timestamps. Events: ``!`` and the event type, with the JSON properties as body. The table
    knows times and types, so range and metrics become predicates of its scan.
    """
    src = table(spark, sf, "events").filter("event_type is not null and user_id is not null and ts is not null")
    user, cohort = F.col("user_id").cast("string"), F.pmod(F.col("user_id"), F.lit(4)).cast("string")
    by_type = F.concat(F.lit(" cohort="), cohort, F.lit(" user="), user)
    pair = F.concat(F.lit(" type="), F.col("event_type"), F.lit(" user="), user)
    ts = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns")
    name = {"": F.concat("event_type", by_type), "ev.value": F.concat(F.lit("ev.value"), pair), "ev.k": F.concat(F.lit("ev.k"), pair), "!": F.concat(F.lit("!"), F.col("event_type"), by_type)}
    value = {"": F.col("value"), "ev.value": F.col("value"), "ev.k": F.get_json_object("props", "$.k").cast("double")}

    def between(r: Range | None) -> DataFrame:
        if r is None:
            return src
        a, b = sorted((r.begin, r.end))
        return src.filter((F.col("ts") >= _literal(a)) & (F.col("ts") <= _literal(b)))

    def prune(r: Range | None, metrics: tuple[str, ...]) -> DataFrame:
        rows = between(r)
        types = [m for m in metrics if m not in ("ev.value", "ev.k")]
        kinds = [k for k in value if (k in metrics if k else types or not metrics)] or [""]
        if metrics and kinds == [""]:
            rows = rows.filter(F.col("event_type").isin(types))
        each = [F.struct(F.xxhash64(name[k]).alias("series_id"), value[k].alias("value")) for k in (kinds if metrics else value)]
        if len(each) == 1:
            out = rows.select(each[0].getField("series_id").alias("series_id"), ts, each[0].getField("value").alias("value"))
        else:
            out = rows.select(ts, F.explode(F.array(*each)).alias("x")).select("x.series_id", "ts_ns", "x.value")
        return out.filter(present("value"))

    def prune_events(r: Range | None, metrics: tuple[str, ...]) -> DataFrame:
        rows = between(r)
        if metrics:
            rows = rows.filter(F.col("event_type").isin([m[1:] for m in metrics]))
        return rows.select((-F.abs(F.xxhash64(name["!"]))).alias("series_id"), ts, F.col("props").alias("body"))

    # the dimension holds four rows per pair of type and user, whatever the number of events
    typed = F.create_map(F.lit("cohort"), cohort, F.lit("user"), user)
    paired = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), user)
    metric = {"": F.col("event_type"), "ev.value": F.lit("ev.value"), "ev.k": F.lit("ev.k"), "!": F.concat(F.lit("!"), "event_type")}
    series = [F.struct((-F.abs(F.xxhash64(name[k])) if k == "!" else F.xxhash64(name[k])).alias("series_id"), name[k].alias("series"), metric[k].alias("metric"), (paired if k.startswith("ev.") else typed).alias("tags")) for k in name]
    dim = src.select("event_type", "user_id").distinct().select(F.explode(F.array(*series)).alias("d")).select("d.*")
    # written once: a request looks at the series several times, and never again at the facts for them
    return Catalog(prune(None, ()), prune_events(None, ()), materialize(dim), prune, prune_events)
