"""From a parsed request to a DataFrame: series, ts_ns and a value, a body or a tuple of columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.apply import Frame, run_steps
from tidewell.operators import aggregate, join, meta
from tidewell.operators.common import attach_dimension
from tidewell.operators.select import bounded, in_range, matching_series, projected, selected, selection
from tidewell.plans.catalog import Catalog
from tidewell.plans.spec import Query, parse, parse_search, parse_suggest


def _ordered(out: DataFrame, q: Query) -> DataFrame:
    """Sort only where the request asks for it or cuts the result: a total order is dear."""
    if q.order is None and q.limit is None and not q.offset:
        return out
    backward = q.range is not None and q.range.backward
    if q.order == "series" and not q.tags:
        keys = [F.col("series").asc(), F.col("ts_ns").desc() if backward else F.col("ts_ns").asc()]
    else:
        cols = ("series", "ts_ns") if q.order == "series" else ("ts_ns", "series")
        keys = [F.col(c).desc() if backward else F.col(c).asc() for c in cols]
    # rows of projected series may tie in both; the values decide then
    keys += [F.col(c).asc() for c in out.columns if c not in ("series", "ts_ns")]
    out = out.orderBy(*keys)
    if q.offset:
        out = out.offset(q.offset)
    return out.limit(q.limit) if q.limit is not None else out


def _rows(cat: Catalog, q: Query, events: bool = False) -> DataFrame:
    """Rows of a query's series in its range, repeats removed after everything else was narrowed."""
    rows = selected((cat.scan_events if events else cat.scan)(q.range, q.metrics), cat.series, q)
    return _distinct(cat, rows, "body" if events else "value")


def _distinct(cat: Catalog, rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.dropDuplicates(["series_id", "ts_ns", value]) if cat.repeats else rows


def _states(cat: Catalog, q: Query) -> DataFrame:
    """States per metric, tag_key and, with a step, bucket: from the catalog's roll-up where its periods fit, and raw rows for the rest."""
    keys = ["metric", "tag_key"] + (["bucket"] if q.step else [])
    roll = cat.rollup
    inside = aggregate.whole_periods(q.range, roll.step) if roll else None
    if q.step and inside and (q.range.backward or q.step % roll.step or q.range.begin % roll.step):
        inside = None
    if not inside:
        rows = _rows(cat, q)
        return aggregate.states(aggregate.with_bucket(rows, q) if q.step else rows, keys, **aggregate.needs(q))
    dim, n = selection(cat.series, q)
    start, ts = F.col("start_ns"), F.col("ts_ns")
    whole = attach_dimension(roll.states.filter((start >= inside[0]) & (start < inside[1])), dim, "series_id", ["start_ns"], size=n)
    parts = [(aggregate.with_bucket(whole, q, "start_ns") if q.step else whole).select(*keys, *aggregate.STATE)]
    if q.range is not None:
        ends = in_range(cat.scan(q.range, q.metrics), q.range).filter((ts < inside[0]) | (ts >= inside[1]))
        rows = _distinct(cat, attach_dimension(ends, dim, "series_id", ["ts_ns"], size=n))
        parts.append(aggregate.as_states(aggregate.with_bucket(rows, q) if q.step else rows, keys))
    return aggregate.merged(reduce(DataFrame.unionByName, parts), keys)


def _select(cat: Catalog, q: Query) -> Frame:
    rows = _rows(cat, q)
    if q.filters:
        rows = rows.filter(bounded(F.col("value"), q.filters[0][1]))
    name = F.concat("metric", F.lit(" "), F.col("tag_key"))
    return Frame(rows.select(name.alias("series"), "ts_ns", "value"), ("value",), {q.metrics[0]: "value"})


def _select_events(cat: Catalog, q: Query) -> Frame:
    rows = _rows(cat, q, True)
    if q.regex is not None:
        rows = rows.filter(F.col("body").rlike(q.regex))
    return Frame(rows.select(F.concat("metric", F.lit(" "), F.col("tag_key")).alias("series"), "ts_ns", "body"), ("body",), {})


def _aggregate(cat: Catalog, q: Query) -> Frame:
    return Frame(aggregate.per_series(_states(cat, q), q), ("value",), {m: "value" for m in q.metrics})


def _group_aggregate(cat: Catalog, q: Query) -> Frame:
    out = aggregate.per_bucket(_states(cat, q), q)
    names = {f"{q.metrics[0]}:{f}": f for f in q.functions} if len(q.metrics) == 1 else {}
    return Frame(out, q.functions, {q.metrics[0]: q.functions[0]} | names, regular=True)


def _join(cat: Catalog, q: Query) -> Frame:
    rows = _rows(cat, q)
    dim = projected(matching_series(cat.series, q), q)
    out = (join.joined if q.kind == "join" else join.joined_buckets)(rows, dim, q)
    return Frame(out, tuple(join.element_names(q)), dict(zip(q.metrics, join.element_names(q), strict=True)), regular=q.kind != "join")


_BUILDERS = {"select": _select, "select-events": _select_events, "aggregate": _aggregate, "group-aggregate": _group_aggregate, "join": _join, "group-aggregate-join": _join}


def in_default_order(q: Query) -> Query:
    """The query with the order that answers have where none is asked for: by time, or by series where a row stands for a whole series."""
    if q.order is not None or (q.apply and q.apply[-1]["name"] == "top"):
        return q
    return replace(q, order="series" if q.kind in ("aggregate", "names") else "time")


def build(cat: Catalog, request: Query | str | Mapping[str, Any]) -> DataFrame:
    """The result of a query as a lazy DataFrame, sorted only where the request asks for it. Errors of the request are raised here."""
    q = request if isinstance(request, Query) else parse(request)
    if q.kind == "names":
        return _cut(meta.series_names(cat.series, q), q)
    f = _BUILDERS[q.kind](cat, q)
    f = Frame(f.rows, f.columns, f.names, q.range is not None and q.range.backward, f.regular)
    return _ordered(run_steps(f, q.apply).rows, q)


def _cut(out: DataFrame, q: Query) -> DataFrame:
    if q.limit is None and not q.offset and q.order is None:
        return out
    out = out.orderBy("series").offset(q.offset)
    return out.limit(q.limit) if q.limit is not None else out


def suggest(cat: Catalog, request: str | Mapping[str, Any]) -> DataFrame:
    return meta.suggestions(cat.series, parse_suggest(request))


def search(cat: Catalog, request: str | Mapping[str, Any]) -> DataFrame:
    q = parse_search(request)
    return _cut(meta.series_names(cat.series, q), q)
