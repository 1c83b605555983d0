"""One query per operator of the request language, over the generic events, with the same in SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.api import Engine
from tidewell.functions.names import canonical
from tidewell.functions.timefmt import iso_column
from tidewell.operators import aggregate, meta
from tidewell.operators.anomaly import anomalies
from tidewell.operators.late_write import mark_late
from tidewell.operators.select import matching_series
from tidewell.plans.build import build, search, suggest
from tidewell.plans.catalog import clicks, domain, rolled_up
from tidewell.plans.spec import Range, parse
from tidewell.session import prepare, remove_at_exit, shared_folder
from tidewell.sinks.text import csv_lines, resp_frames
from tidewell.sources.lines import parse_bulk, parse_put
from tidewell.sources.resp import MAX_ROW, read_frames
from tidewell.sources.tables import table
from tidewell.streaming.buckets import standing_buckets
from tidewell.streaming.ingest import Store
from tidewell.streaming.late_write import LateRule

#: Beyond the times of the table on both sides.
FROM, TO = "20231201T000000", "20240301T000000"
A, B = 1701388800000000000, 1709251200000000000
FORWARD, BACKWARD = {"from": FROM, "to": TO}, {"from": TO, "to": FROM}
STEP, STEP_NS = "6h", 21_600_000_000_000

#: The series of the events table, as the catalog makes them.
S = """
WITH e AS (SELECT epoch_us(ts) * 1000 AS ts_ns, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, props, event_type AS t, user_id AS u FROM events
  WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL),
s AS (
  SELECT t AS metric, 'cohort=' || (u % 4) || ' user=' || u AS tags, t, u, ts_ns, value FROM e WHERE value IS NOT NULL AND NOT isnan(value)
  UNION ALL SELECT 'ev.value', 'type=' || t || ' user=' || u, t, u, ts_ns, value FROM e WHERE value IS NOT NULL AND NOT isnan(value)
  UNION ALL SELECT 'ev.k', 'type=' || t || ' user=' || u, t, u, ts_ns, k FROM e WHERE k IS NOT NULL),
"""
FW = f"ts_ns >= {A} AND ts_ns < {B}"
BW = f"ts_ns > {A} AND ts_ns <= {B}"
BUCKET = f"{A} + (ts_ns - {A}) // {STEP_NS} * {STEP_NS}"
BUCKET_BW = f"{B} - ({B} - ts_ns) // {STEP_NS} * {STEP_NS}"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _tidy(out: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show."""
    return out.select(*(F.round(c, digits).alias(c) if kind == "double" else c for c, kind in out.dtypes))


def ask(name: str, request: dict[str, Any], sql: str | None, digits: int | None = None) -> None:
    """Register a request and its SQL."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        prepare(spark)
        out = build(clicks(spark, sf), request)
        return out if digits is None else _tidy(out, digits)

    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = S + sql


def _click(where: str = FW, more: str = "") -> str:
    return f"r AS (SELECT * FROM s WHERE metric = 'click' AND {where} {more})"


_ROWS = " SELECT metric || ' ' || tags AS series, ts_ns, value FROM r"

# scans, predicates, series selection
ask("select_forward", {"select": "click", "range": FORWARD}, _click() + _ROWS)
ask("select_backward", {"select": "click", "range": BACKWARD}, _click(BW) + _ROWS)
ask("select_narrow_range", {"select": "click", "range": {"from": "20240105T000000", "to": "20240125T000000"}}, _click("ts_ns >= 1704412800000000000 AND ts_ns < 1706140800000000000") + _ROWS)
ask("select_where_values", {"select": "click", "range": FORWARD, "where": {"cohort": ["1", "2"]}}, _click(more="AND u % 4 IN (1, 2)") + _ROWS)
ask("select_where_exact", {"select": "click", "range": FORWARD, "where": [{"cohort": "1", "user": "5"}, {"user": "10", "cohort": "2"}, {"user": "7"}]}, _click(more="AND u IN (5, 10)") + _ROWS)
ask("select_filter_gt_lt", {"select": "click", "range": FORWARD, "filter": {"gt": 20, "lt": 80}}, _click(more="AND value > 20 AND value < 80") + _ROWS)
ask("select_filter_ge_le", {"select": "click", "range": FORWARD, "filter": {"click": {"ge": 20, "le": 80}}}, _click(more="AND value >= 20 AND value <= 80") + _ROWS)
ask("select_group_by_tag", {"select": "click", "range": FORWARD, "group-by-tag": ["user"]}, _click() + " SELECT 'click cohort=' || (u % 4) AS series, ts_ns, value FROM r")
ask("select_pivot_by_tag", {"select": "click", "range": FORWARD, "pivot-by-tag": ["user"]}, _click() + " SELECT 'click user=' || u AS series, ts_ns, value FROM r")
ask("select_order_time", {"select": "click", "range": FORWARD, "order-by": "time"}, _click() + _ROWS)
ask("select_order_series_backward", {"select": "click", "range": BACKWARD, "order-by": "series"}, _click(BW) + _ROWS)
ask("select_limit", {"select": "click", "range": FORWARD, "limit": 100}, _click() + _ROWS + " ORDER BY ts_ns, series, value LIMIT 100")
ask("select_offset_limit", {"select": "click", "range": BACKWARD, "order-by": "series", "limit": 50, "offset": 25}, _click(BW) + _ROWS + " ORDER BY series, ts_ns DESC, value LIMIT 50 OFFSET 25")


# aggregates
def _edge(order: str, value: str = "value") -> str:
    return f"r2 AS (SELECT *, row_number() OVER (PARTITION BY tags ORDER BY {order}) AS n FROM r) SELECT 'click:{{f}} ' || tags AS series, ts_ns, {value} AS value FROM r2 WHERE n = 1"


_AGG = {
    "min": _edge("value, ts_ns"),
    "max": _edge("value DESC, ts_ns"),
    "min_timestamp": _edge("value, ts_ns", "CAST(ts_ns AS DOUBLE)"),
    "max_timestamp": _edge("value DESC, ts_ns", "CAST(ts_ns AS DOUBLE)"),
    "first": _edge("ts_ns, value"),
    "last": _edge("ts_ns DESC, value DESC"),
    "first_timestamp": _edge("ts_ns", "CAST(NULL AS DOUBLE)"),
    "last_timestamp": _edge("ts_ns DESC", "CAST(NULL AS DOUBLE)"),
}
for _f, _v in (("sum", "sum(value)"), ("count", "CAST(count(*) AS DOUBLE)"), ("mean", "avg(value)")):
    _AGG[_f] = f"r2 AS (SELECT tags, max(ts_ns) AS ts_ns, {_v} AS value FROM r GROUP BY 1) SELECT 'click:{_f} ' || tags AS series, ts_ns, round(value, 6) AS value FROM r2"
for _f, _sql in _AGG.items():
    ask(f"agg_{_f}", {"aggregate": {"click": _f}, "range": FORWARD}, _click() + ", " + _sql.format(f=_f), 6)
_TWO = "r AS (SELECT * FROM s WHERE " + FW + ") SELECT 'click:max ' || {0} AS series, max_by(ts_ns, (value, -ts_ns)) AS ts_ns, max(value) AS value FROM r WHERE metric = 'click' GROUP BY {0} UNION ALL SELECT 'purchase:sum ' || {0}, max(ts_ns), round(sum(value), 6) FROM r WHERE metric = 'purchase' GROUP BY {0}"
ask("agg_multi_metric", {"aggregate": {"click": "max", "purchase": "sum"}, "range": FORWARD}, _TWO.format("tags"), 6)
ask("agg_group_by_tag", {"aggregate": {"click": "max", "purchase": "sum"}, "range": FORWARD, "group-by-tag": ["user"]}, _TWO.format("('cohort=' || (u % 4))"), 6)
ask("agg_pivot_by_tag", {"aggregate": {"click": "max", "purchase": "sum"}, "range": FORWARD, "pivot-by-tag": ["user"]}, _TWO.format("('user=' || u)"), 6)
ask("agg_no_range", {"aggregate": {"click": "count"}}, "r AS (SELECT * FROM s WHERE metric = 'click') SELECT 'click:count ' || tags AS series, max(ts_ns) AS ts_ns, CAST(count(*) AS DOUBLE) AS value FROM r GROUP BY tags")

# buckets
_MEAN = " SELECT '{h} ' || {k} AS series, {b} AS ts_ns, min(value) AS min, round(avg(value), 6) AS mean, CAST(count(*) AS DOUBLE) AS count FROM r GROUP BY {k}, {b}"
_G = {"step": STEP, "metric": "click", "func": ["min", "mean", "count"]}
_H = "click:min|click:mean|click:count"
ask("group_agg_forward", {"group-aggregate": _G, "range": FORWARD}, _click() + _MEAN.format(h=_H, k="tags", b=BUCKET), 6)
ask("group_agg_backward", {"group-aggregate": _G, "range": BACKWARD}, _click(BW) + _MEAN.format(h=_H, k="tags", b=BUCKET_BW), 6)
ask("group_agg_group_by_tag", {"group-aggregate": _G, "range": FORWARD, "group-by-tag": ["user"]}, _click() + _MEAN.format(h=_H, k="('cohort=' || (u % 4))", b=BUCKET), 6)
ask("group_agg_pivot_by_tag", {"group-aggregate": _G, "range": FORWARD, "pivot-by-tag": ["user"]}, _click() + _MEAN.format(h=_H, k="('user=' || u)", b=BUCKET), 6)
ask(
    "group_agg_multi_metric",
    {"group-aggregate": {"step": STEP, "metric": ["click", "view"], "func": ["max", "sum"]}, "range": FORWARD},
    f"r AS (SELECT * FROM s WHERE metric IN ('click', 'view') AND {FW}) SELECT metric || ':max|' || metric || ':sum ' || tags AS series, {BUCKET} AS ts_ns, max(value) AS max, round(sum(value), 6) AS sum FROM r GROUP BY metric, tags, {BUCKET}",
    6,
)
_ALL = ["min", "max", "sum", "count", "min_timestamp", "max_timestamp", "mean", "last", "first", "last_timestamp", "first_timestamp"]
ask(
    "group_agg_all_funcs",
    {"group-aggregate": {"step": "1d", "metric": "ev.value", "func": _ALL}, "range": FORWARD, "pivot-by-tag": ["type"]},
    f"r AS (SELECT *, {A} + (ts_ns - {A}) // 86400000000000 * 86400000000000 AS b FROM s WHERE metric = 'ev.value' AND {FW}) SELECT '{'|'.join('ev.value:' + f for f in _ALL)} type=' || t AS series, b AS ts_ns, min(value) AS min, max(value) AS max, round(sum(value), 6) AS sum, CAST(count(*) AS DOUBLE) AS count, CAST(arg_min(ts_ns, (value, ts_ns)) AS DOUBLE) AS min_timestamp, CAST(arg_max(ts_ns, (value, -ts_ns)) AS DOUBLE) AS max_timestamp, round(avg(value), 6) AS mean, arg_max(value, (ts_ns, value)) AS last, arg_min(value, (ts_ns, value)) AS first, CAST(max(ts_ns) AS DOUBLE) AS last_timestamp, CAST(min(ts_ns) AS DOUBLE) AS first_timestamp FROM r GROUP BY t, b",
    6,
)
_FILTERED = {"group-aggregate": {"step": STEP, "metric": "click", "func": ["min", "max"]}, "range": FORWARD}
_HAVING = " SELECT 'click:min|click:max ' || tags AS series, {b} AS ts_ns, min(value) AS min, max(value) AS max FROM r GROUP BY tags, {b} HAVING min(value) > 10 {o} max(value) <= 60"
ask("group_agg_filter_all", _FILTERED | {"filter": {"min": {"gt": 10}, "max": {"le": 60}}}, _click() + _HAVING.format(b=BUCKET, o="AND"))
ask("group_agg_filter_any", _FILTERED | {"filter": {"min": {"gt": 10}, "max": {"le": 60}, "=": {"require": "any"}}}, _click() + _HAVING.format(b=BUCKET, o="OR"))

# joins
_JOIN = f"a AS (SELECT tags, ts_ns, max(value) AS x FROM s WHERE metric = 'ev.value' AND {FW} {{x}} GROUP BY ALL), b AS (SELECT tags, ts_ns, max(value) AS x FROM s WHERE metric = 'ev.k' AND {FW} {{y}} GROUP BY ALL) SELECT 'ev.value|ev.k ' || coalesce(a.tags, b.tags) AS series, coalesce(a.ts_ns, b.ts_ns) AS ts_ns, a.x AS c0, b.x AS c1 FROM a FULL JOIN b ON a.tags = b.tags AND a.ts_ns = b.ts_ns"
ask("join_two", {"join": ["ev.value", "ev.k"], "range": FORWARD}, _JOIN.format(x="", y=""))
ask("join_filter", {"join": ["ev.value", "ev.k"], "range": FORWARD, "filter": {"ev.value": {"gt": 50}, "ev.k": {"lt": 40}}}, _JOIN.format(x="AND value > 50", y="AND value < 40"))
ask("join_self", {"join": ["ev.k", "ev.k"], "range": BACKWARD}, f"r AS (SELECT tags, ts_ns, max(value) AS x FROM s WHERE metric = 'ev.k' AND {BW} GROUP BY ALL) SELECT 'ev.k|ev.k ' || tags AS series, ts_ns, x AS c0, x AS c1 FROM r")
_GJ = f"keys AS (SELECT DISTINCT tags FROM s WHERE metric = 'click'), g AS (SELECT metric, tags, {BUCKET} AS b, max(value) AS x FROM s JOIN keys USING (tags) WHERE metric IN ('click', 'purchase') AND {FW} GROUP BY ALL), a AS (SELECT * FROM g WHERE metric = 'click' {{x}}), p AS (SELECT * FROM g WHERE metric = 'purchase' {{y}}) SELECT 'click|purchase ' || coalesce(a.tags, p.tags) AS series, coalesce(a.b, p.b) AS ts_ns, a.x AS c0, p.x AS c1 FROM a FULL JOIN p ON a.tags = p.tags AND a.b = p.b"
_GJQ = {"group-aggregate-join": {"step": STEP, "metric": ["click", "purchase"], "func": "max"}, "range": FORWARD}
ask("group_agg_join", _GJQ, _GJ.format(x="", y=""))
ask("group_agg_join_filter", _GJQ | {"filter": {"purchase": {"ge": 30}}}, _GJ.format(x="", y="AND x >= 30"))

# functions on tuples and single values
_SPARSE = _GJ.format(x="", y="")


def _over(sql: str, value: str, where: str = "") -> str:
    head, _, body = sql.rpartition(") SELECT ")
    return f"{head}), j AS (SELECT {body}) SELECT series, ts_ns, {value} FROM j {where}"


def fn(name: str, **p: Any) -> dict[str, Any]:
    return {"apply": [{"name": name} | p]}


_J = {"join": ["ev.value", "ev.k"], "range": FORWARD}
ask("apply_abs", {"select": "click", "range": FORWARD, "apply": [{"name": "scale", "weights": [-2]}, {"name": "abs"}]}, _click() + _ROWS.replace("value FROM", "abs(value * -2) AS value FROM"))
ask("apply_scale", _J | fn("scale", weights=[0.5, -1]), _over(_JOIN.format(x="", y=""), "c0 * 0.5::DOUBLE AS c0, c1 * -1::DOUBLE AS c1"))
ask("apply_sum", _GJQ | fn("sum", ignore_missing=True), _over(_SPARSE, "round(coalesce(c0, 0) + coalesce(c1, 0), 6) AS value"), 6)
ask("apply_diff", _GJQ | fn("diff", ignore_missing=True), _over(_SPARSE, "round(0 - coalesce(c0, 0) - coalesce(c1, 0), 6) AS value"), 6)
ask("apply_multiply", _GJQ | fn("multiply", ignore_missing=True), _over(_SPARSE, "round(coalesce(c0, 1) * coalesce(c1, 1), 6) AS value"), 6)
ask("apply_divide", _J | fn("divide", ignore_missing=True) | {"filter": {"ev.value": {"gt": 0.5}, "ev.k": {"gt": 0}}}, _over(_JOIN.format(x="AND value > 0.5", y="AND value > 0"), "round(1::DOUBLE / coalesce(c0, 1) / coalesce(c1, 1), 9) AS value"), 9)
ask("apply_eval", _J | fn("eval", expr="2 * ev.value - ev.k / 4 + (ev.k > 50 ? 1 : -1)"), _over(_JOIN.format(x="", y=""), "round(2 * coalesce(c0, 0) - coalesce(c1, 0) / 4::DOUBLE + CASE WHEN coalesce(c1, 0) > 50 THEN 1 ELSE -1 END, 6) AS value"), 6)
_W = "WINDOW w AS (PARTITION BY tags ORDER BY ts_ns{d})"
_D = "SELECT 'click ' || tags AS series, ts_ns, {v} AS value FROM r " + _W
ask("apply_rate", {"select": "click", "range": FORWARD} | fn("rate"), _click() + _D.format(v="round((value - lag(value) OVER w) / (ts_ns - lag(ts_ns) OVER w)::DOUBLE * 1000000000, 9)", d=""), 9)
ask("apply_rate_backward", {"select": "click", "range": BACKWARD} | fn("rate"), _click(BW) + _D.format(v="round((value - lag(value) OVER w) / (ts_ns - lag(ts_ns) OVER w)::DOUBLE * 1000000000, 9)", d=" DESC"), 9)
ask("apply_cusum", {"select": "click", "range": FORWARD} | fn("cusum"), _click() + _D.format(v="round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 6)", d=""), 6)
ask("apply_accumulate_backward", {"select": "click", "range": BACKWARD} | fn("accumulate"), _click(BW) + _D.format(v="round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 6)", d=" DESC"), 6)
ask("apply_cma", {"select": "click", "range": FORWARD} | fn("cma"), _click() + _D.format(v="round(avg(value) OVER (w ROWS UNBOUNDED PRECEDING), 6)", d=""), 6)
ask("apply_sma", {"select": "click", "range": FORWARD} | fn("sma", **{"window-width": 5}), _click() + _D.format(v="round(avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6)", d=""), 6)
ask("apply_sma_error", {"select": "click", "range": FORWARD} | fn("sma-error", **{"window-width": 5}), _click() + _D.format(v="round(value - avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6)", d=""), 6)
_EW = {"group-aggregate": {"step": STEP, "metric": "ev.value", "func": "mean"}, "range": FORWARD, "pivot-by-tag": ["type"]}
_EWSQL = (
    S.replace("WITH e", "WITH RECURSIVE e", 1)
    + f"""g AS (SELECT 'ev.value:mean type=' || t AS series, {BUCKET} AS ts_ns, avg(value) AS x FROM s WHERE metric = 'ev.value' AND {FW} GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts_ns) AS i FROM g),
f AS (SELECT series, ts_ns, i, x, x AS guess, x AS v FROM n WHERE i = 1
  UNION ALL SELECT n.series, n.ts_ns, n.i, n.x, CASE WHEN n.i <= 11 THEN n.x ELSE f.v END,
    CASE WHEN n.i < 11 THEN f.v + n.x WHEN n.i = 11 THEN (f.v + n.x) / 11 * 0.7::DOUBLE + n.x * 0.3::DOUBLE ELSE f.v * 0.7::DOUBLE + n.x * 0.3::DOUBLE END
  FROM f JOIN n ON n.series = f.series AND n.i = f.i + 1)
"""
)
ask("apply_ewma", _EW | fn("ewma", decay=0.3), None, 6)
ask("apply_ewma_error", _EW | fn("ewma-error", decay=0.3), None, 6)
ORACLE["apply_ewma"] = _EWSQL + "SELECT series, ts_ns, round(guess, 6) AS mean FROM f"
ORACLE["apply_ewma_error"] = _EWSQL + "SELECT series, ts_ns, round(x - guess, 6) AS mean FROM f"
ask(
    "apply_top",
    {"select": "click", "range": FORWARD} | fn("top", N=10),
    _click() + ", p AS (SELECT tags, ts_ns, lag(value) OVER w * ((ts_ns - lag(ts_ns) OVER w) / 1000000000::DOUBLE) AS x FROM r WINDOW w AS (PARTITION BY tags ORDER BY ts_ns)) SELECT 'click ' || tags AS series, max(ts_ns) AS ts_ns, round(coalesce(sum(x), 0), 3) AS value FROM p GROUP BY tags ORDER BY coalesce(sum(x), 0) DESC, series LIMIT 10",
    3,
)
_HEAVY = ", c AS (SELECT tags, min(ts_ns) AS ts_ns, {w} AS v FROM r GROUP BY 1) SELECT 'click ' || tags AS series, ts_ns, round(v, 6) AS value FROM c WHERE v > (SELECT sum(v) FROM c) * 0.007::DOUBLE"
ask("apply_frequent_items", {"select": "click", "range": FORWARD} | fn("frequent-items", error=0.001, portion=0.007), _click() + _HEAVY.format(w="CAST(count(*) AS DOUBLE)"), 6)
ask("apply_heavy_hitters", {"select": "click", "range": FORWARD} | fn("heavy-hitters", error=0.001, portion=0.007), _click() + _HEAVY.format(w="sum(value)"), 6)
ask("apply_chain", {"select": "click", "range": FORWARD, "apply": [{"name": "cusum"}, {"name": "scale", "weights": [2]}, {"name": "rate"}]}, _click() + ", c AS (SELECT 'click ' || tags AS series, ts_ns, value, lag(ts_ns) OVER w AS p FROM r WINDOW w AS (PARTITION BY tags ORDER BY ts_ns)) SELECT series, ts_ns, round(CASE WHEN p IS NOT NULL THEN 2 * value / (ts_ns - p)::DOUBLE * 1000000000 END, 6) AS value FROM c", 6)

_SAX_CUT = (-0.6744897501960817, 0.0, 0.6744897501960817)
ask(
    "apply_sax",
    {"group-aggregate": {"step": STEP, "metric": "ev.value", "func": "max"}, "range": FORWARD, "pivot-by-tag": ["type"]} | fn("sax", alphabet_size=4, window_width=4),
    f"""g AS (SELECT 'ev.value:max type=' || t AS series, {BUCKET} AS ts_ns, max(value) AS x FROM s WHERE metric = 'ev.value' AND {FW} GROUP BY ALL),
v AS (SELECT *, list(x) OVER f AS xs, avg(x) OVER f AS m, stddev_samp(x) OVER f AS d FROM g WINDOW f AS (PARTITION BY series ORDER BY ts_ns ROWS 3 PRECEDING)),
z AS (SELECT series, ts_ns, list_aggregate(list_transform(xs, lambda y: CASE WHEN (y - m) / (CASE WHEN d < 1e-10 THEN 1 ELSE d END) < {_SAX_CUT[0]} THEN 'a' WHEN (y - m) / (CASE WHEN d < 1e-10 THEN 1 ELSE d END) < 0 THEN 'b' WHEN (y - m) / (CASE WHEN d < 1e-10 THEN 1 ELSE d END) < {_SAX_CUT[2]} THEN 'c' ELSE 'd' END), 'string_agg', '') AS word, len(xs) AS n FROM v),
l AS (SELECT *, lag(word) OVER (PARTITION BY series ORDER BY ts_ns) AS p, lag(n) OVER (PARTITION BY series ORDER BY ts_ns) AS pn FROM z WHERE n = 4)
SELECT series, ts_ns, word FROM l WHERE p IS NULL OR p <> word""",
)

# events
_EV = f"r AS (SELECT '!view cohort=' || (u % 4) || ' user=' || u AS series, u, ts_ns, props AS body FROM e WHERE t = 'view' AND {FW})"
ask("events_select", {"select-events": "!view", "range": FORWARD}, _EV + " SELECT series, ts_ns, body FROM r")
ask("events_regex", {"select-events": "!view", "range": FORWARD, "filter": "[1-3]7"}, _EV + " SELECT series, ts_ns, body FROM r WHERE regexp_matches(body, '[1-3]7')")
ask("events_pivot_limit", {"select-events": "!view", "range": FORWARD, "pivot-by-tag": ["cohort"], "order-by": "time", "limit": 40}, _EV + " SELECT '!view cohort=' || (u % 4) AS series, ts_ns, body FROM r ORDER BY ts_ns, series, body LIMIT 40")


# orders: the rows that a limit leaves prove them
ask("join_order_time", {"join": ["ev.value", "ev.k"], "range": BACKWARD, "order-by": "time", "limit": 60}, _JOIN.replace(FW, BW).format(x="", y="") + " ORDER BY ts_ns DESC, series DESC, c0, c1 LIMIT 60")
ask("join_order_series", {"join": ["ev.value", "ev.k"], "range": FORWARD, "order-by": "series", "offset": 30, "limit": 60}, _JOIN.format(x="", y="") + " ORDER BY series, ts_ns, c0, c1 LIMIT 60 OFFSET 30")
ask("group_agg_order_time", {"group-aggregate": _G, "range": BACKWARD, "order-by": "time", "limit": 60}, _click(BW) + _MEAN.format(h=_H, k="tags", b=BUCKET_BW) + " ORDER BY ts_ns DESC, series DESC LIMIT 60", 6)
ask("group_agg_order_series", {"group-aggregate": _G, "range": FORWARD, "order-by": "series", "limit": 60}, _click() + _MEAN.format(h=_H, k="tags", b=BUCKET) + " ORDER BY series, ts_ns LIMIT 60", 6)
ask("select_order_series_grouped", {"select": "click", "range": FORWARD, "pivot-by-tag": ["cohort"], "order-by": "series", "limit": 60}, _click() + " SELECT 'click cohort=' || (u % 4) AS series, ts_ns, value FROM r ORDER BY series, ts_ns, value LIMIT 60")
ask("select_order_series_grouped_backward", {"select": "click", "range": BACKWARD, "pivot-by-tag": ["cohort"], "order-by": "series", "limit": 60}, _click(BW) + " SELECT 'click cohort=' || (u % 4) AS series, ts_ns, value FROM r ORDER BY series DESC, ts_ns DESC, value LIMIT 60")


# metadata
def of_series(name: str, make: Callable[[Any], DataFrame], sql: str | None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        prepare(spark)
        return make(clicks(spark, sf))

    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = S + sql


_NAMES = "d AS (SELECT DISTINCT metric, tags, t, u FROM s UNION SELECT DISTINCT '!' || t, 'cohort=' || (u % 4) || ' user=' || u, t, u FROM e)"
of_series("meta_names", lambda c: build(c, {"select": "meta:names"}), _NAMES + " SELECT metric || ' ' || tags AS series FROM d")
of_series("meta_names_metric", lambda c: build(c, {"select": "meta:names:click", "where": {"cohort": "3"}}), _NAMES + " SELECT metric || ' ' || tags AS series FROM d WHERE metric = 'click' AND u % 4 = 3")
of_series("search_metric", lambda c: search(c, {"select": "view", "where": {"cohort": ["0", "1"]}}), _NAMES + " SELECT metric || ' ' || tags AS series FROM d WHERE metric = 'view' AND u % 4 IN (0, 1)")
of_series("search_all_metrics", lambda c: search(c, {"select": "", "where": {"user": "7"}, "limit": 8}), _NAMES + " SELECT metric || ' ' || tags AS series FROM d WHERE u = 7 ORDER BY series LIMIT 8")
of_series("suggest_metric_names", lambda c: suggest(c, {"select": "metric-names", "starts-with": "ev"}), _NAMES + " SELECT DISTINCT metric AS name FROM d WHERE starts_with(metric, 'ev')")
of_series("suggest_tag_names", lambda c: suggest(c, {"select": "tag-names", "metric": "click"}), "d AS (SELECT 1) SELECT unnest(['cohort', 'user']) AS name")
of_series("suggest_tag_values", lambda c: suggest(c, {"select": "tag-values", "metric": "ev.k", "tag": "user", "starts-with": "1"}), _NAMES + " SELECT DISTINCT CAST(u AS VARCHAR) AS name FROM d WHERE metric = 'ev.k' AND starts_with(CAST(u AS VARCHAR), '1')")
of_series(
    "meta_topology",
    lambda c: meta.topology(c.series.filter(~F.col("metric").startswith("!"))),
    "d AS (SELECT DISTINCT metric, t, u FROM s), k AS (SELECT metric, 'user' AS tag, CAST(u AS VARCHAR) AS v FROM d UNION ALL SELECT metric, 'cohort', CAST(u % 4 AS VARCHAR) FROM d WHERE metric NOT LIKE 'ev.%' UNION ALL SELECT metric, 'type', t FROM d WHERE metric LIKE 'ev.%') SELECT metric, tag, v AS tag_value, count(*) AS n_series FROM k GROUP BY ALL",
)
of_series("meta_exclude_tags", lambda c: meta.without_tags(c.series, parse({"select": "click", "range": FORWARD, "where": {"cohort": ["1"]}})).select("series"), _NAMES + " SELECT metric || ' ' || tags AS series FROM d WHERE metric = 'click' AND u % 4 <> 1")
of_series("meta_join_by_tags", lambda c: meta.same_tags(c.series, ("click", "purchase")).select("tag_key", F.col("id1").isNotNull().alias("paired")), _NAMES + " SELECT tags AS tag_key, tags IN (SELECT tags FROM d WHERE metric = 'purchase') AS paired FROM d WHERE metric = 'click'")


# operators without a statement of their own
def _one_series(c: Any) -> DataFrame:
    return build(c, {"select": "ev.value", "range": FORWARD, "pivot-by-tag": ["type"]})


of_series("candlesticks", lambda c: aggregate.candlesticks(_one_series(c), Range(A, B), STEP_NS), f"r AS (SELECT 'ev.value type=' || t AS series, {BUCKET} AS b, ts_ns, value FROM s WHERE metric = 'ev.value' AND {FW}) SELECT series, b AS ts_ns, arg_min(value, (ts_ns, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts_ns, value)) AS close FROM r GROUP BY ALL")
of_series(
    "rollup_read",
    lambda c: _tidy(aggregate.from_rollup(aggregate.rollup(_one_series(c), 3_600_000_000_000)), 6),
    f"r AS (SELECT 'ev.value type=' || t AS series, ts_ns, value FROM s WHERE metric = 'ev.value' AND {FW}) SELECT series, CAST(count(*) AS DOUBLE) AS count, round(sum(value), 6) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, arg_min(value, (ts_ns, value)) AS first, arg_max(value, (ts_ns, value)) AS last, arg_min(ts_ns, (value, ts_ns)) AS min_ts, arg_max(ts_ns, (value, -ts_ns)) AS max_ts, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts FROM r GROUP BY series",
)


def _posting(name: str, sql: str, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Two sets of series of a metric, put together by id; the tests of the sets are predicates on the dimension."""

    def run(c: Any) -> DataFrame:
        one, two = (matching_series(c.series, parse({"select": "click", "range": FORWARD, "where": {"cohort": w}})).select("series") for w in (["0", "1", "2"], ["2", "3"]))
        return combine(one, two)

    of_series(name, run, _NAMES + f" SELECT metric || ' ' || tags AS series FROM d WHERE metric = 'click' AND {sql}")


_posting("posting_list_difference", "u % 4 IN (0, 1)", DataFrame.exceptAll)
_posting("posting_list_intersection", "u % 4 = 2", DataFrame.intersect)
_posting("posting_list_union", "u % 4 IN (0, 1, 2, 3)", lambda a, b: a.union(b).distinct())


of_series("series_regex", lambda c: meta.names_like(c.series, "^(click|view) .*user=1[0-9]$"), _NAMES + " SELECT metric || ' ' || tags AS series FROM d WHERE regexp_matches(metric || ' ' || tags, '^(click|view) .*user=1[0-9]$')")


# the façade: lines of an answer with their places, and numbers of the catalog
def _answer(spark: SparkSession, sf: str) -> DataFrame:
    ask_ = {"group-aggregate": {"step": "1d", "metric": "ev.value", "func": ["min", "max"]}, "range": FORWARD, "pivot-by-tag": ["type"], "output": {"format": "csv", "timestamp": "raw"}}
    status, lines = Engine(spark, clicks(spark, sf)).respond("/api/query", json.dumps(ask_))
    # a line per day and type
    return spark.createDataFrame([(i, status, line) for i, line in enumerate(lines)], "place bigint, status bigint, line string")


def of_facade(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        prepare(spark)
        return make(spark, sf)

    QUERIES[name] = run
    ORACLE[name] = S + sql


of_facade(
    "api_query",
    _answer,
    f"r AS (SELECT t, {A} + (ts_ns - {A}) // 86400000000000 * 86400000000000 AS b, min(value) AS lo, max(value) AS hi FROM s WHERE metric = 'ev.value' AND {FW} GROUP BY ALL) SELECT row_number() OVER (ORDER BY b, t) - 1 AS place, CAST(200 AS BIGINT) AS status, 'ev.value:min|ev.value:max type=' || t || ',ts=' || b || ',' || printf('%.17g', lo) || ',' || printf('%.17g', hi) AS line FROM r",
)
of_facade(
    "api_stats",
    lambda spark, sf: spark.createDataFrame(list(Engine(spark, clicks(spark, sf)).stats().items()), "name string, n bigint"),
    _NAMES + ", n AS (SELECT (SELECT count(*) FROM d) AS series, (SELECT count(DISTINCT metric) FROM d) AS metrics, (SELECT count(*) FROM s) AS samples, (SELECT count(*) FROM e WHERE props IS NOT NULL) AS events) SELECT 'series' AS name, series AS n FROM n UNION ALL SELECT 'metrics', metrics FROM n UNION ALL SELECT 'samples', samples FROM n UNION ALL SELECT 'events', events FROM n",
)
of_facade(
    "api_function_names",
    lambda spark, sf: spark.createDataFrame([(x,) for x in Engine(spark, clicks(spark, sf)).respond("/api/function-names")[1]], "name string"),
    "d AS (SELECT 1) SELECT unnest(['abs', 'accumulate', 'anomaly-detector', 'cma', 'cusum', 'diff', 'divide', 'eval', 'ewma', 'ewma-error', 'frequent-items', 'heavy-hitters', 'multiply', 'rate', 'sax', 'scale', 'sma', 'sma-error', 'sum', 'top']) AS name",
)


# streams, run until their input is used up
def _streamed(spark: SparkSession, sf: str, name: str) -> tuple[DataFrame, str]:
    """A table as a stream of its files, and a folder for what becomes of it."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    path = f"{sf}/{name}.parquet"
    whole = spark.read.parquet(path)
    if whole.inputFiles() and whole.inputFiles()[0].rstrip("/").endswith(f"{name}.parquet"):
        # the file source wants a folder
        return spark.readStream.schema(whole.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf), folder
    return spark.readStream.schema(whole.schema).parquet(path), folder


def _standing(spark: SparkSession, sf: str) -> DataFrame:
    src, folder = _streamed(spark, sf, "events")
    src = src.select(F.concat(F.lit("ev.value type="), F.col("event_type")).alias("series"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), "value")
    out = standing_buckets(src, STEP_NS, ["min", "max", "count"], A)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("series string, ts_ns bigint, min double, max double, count double").parquet(f"{folder}/out")


of_facade(
    "stream_buckets",
    _standing,
    f"r AS (SELECT 'ev.value type=' || t AS series, {BUCKET} AS b, ts_ns, value FROM s WHERE metric = 'ev.value'), w AS (SELECT max(ts_ns) // 1000000 * 1000000 - 3600000000000 AS mark FROM r) SELECT series, b AS ts_ns, min(value) AS min, max(value) AS max, CAST(count(*) AS DOUBLE) AS count FROM r, w GROUP BY series, b, mark HAVING b + {STEP_NS} <= mark",
)


# aggregates from a roll-up: the SQL reads the raw rows
HOUR = 3_600_000_000_000
of_series(
    "agg_from_rollup",
    lambda c: _tidy(build(rolled_up(c, HOUR), {"aggregate": {"click": "min", "view": "last", "purchase": "mean"}, "range": {"from": A + 12345, "to": B - 6789}}), 6),
    f"r AS (SELECT * FROM s WHERE ts_ns >= {A + 12345} AND ts_ns < {B - 6789}) SELECT 'click:min ' || tags AS series, arg_min(ts_ns, (value, ts_ns)) AS ts_ns, min(value) AS value FROM r WHERE metric = 'click' GROUP BY tags UNION ALL SELECT 'view:last ' || tags, max(ts_ns), arg_max(value, (ts_ns, value)) FROM r WHERE metric = 'view' GROUP BY tags UNION ALL SELECT 'purchase:mean ' || tags, max(ts_ns), round(avg(value), 6) FROM r WHERE metric = 'purchase' GROUP BY tags",
)
of_series(
    "group_agg_from_rollup",
    lambda c: _tidy(build(rolled_up(c, HOUR), {"group-aggregate": _G, "range": {"from": FROM, "to": "20240115T001500"}, "group-by-tag": ["user"]}), 6),
    "r AS (SELECT * FROM s WHERE metric = 'click' AND ts_ns >= " + f"{A} AND ts_ns < 1705277700000000000)" + _MEAN.format(h=_H, k="('cohort=' || (u % 4))", b=BUCKET),
)


# queries over the project's own tables
def of_tables(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        prepare(spark)
        return make(spark, sf)

    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


_RAW = {"from": 0, "to": 2000000000000000000}
_DIM = "WITH d AS (SELECT series_id, min(series) AS series FROM series_dim WHERE series_id IS NOT NULL AND series IS NOT NULL GROUP BY 1), m AS (SELECT *, string_split(series, ' ')[1] AS metric FROM d)"
of_tables(
    "domain_group_agg",
    lambda spark, sf: build(domain(spark, sf), {"group-aggregate": {"step": "1h", "metric": ["cpu.load", "sensor.temp"], "func": ["min", "max", "count"]}, "range": _RAW, "pivot-by-tag": ["site"]}),
    _DIM + ", v AS (SELECT DISTINCT series_id, ts_ns, value FROM samples WHERE value IS NOT NULL AND NOT isnan(value) AND ts_ns >= 0 AND ts_ns < 2000000000000000000), r AS (SELECT metric, regexp_extract(series, ' site=([^ ]+)', 1) AS site, ts_ns // 3600000000000 * 3600000000000 AS b, value FROM v JOIN m USING (series_id) WHERE metric IN ('cpu.load', 'sensor.temp')) SELECT metric || ':min|' || metric || ':max|' || metric || ':count site=' || site AS series, b AS ts_ns, min(value) AS min, max(value) AS max, CAST(count(*) AS DOUBLE) AS count FROM r WHERE site <> '' GROUP BY metric, site, b",
)
of_tables(
    "domain_events_regex",
    lambda spark, sf: build(domain(spark, sf), {"select-events": "!alarm", "range": {"from": 0, "to": 2000000000000000000}, "filter": "degraded|\"code\":2"}),
    _DIM + ", v AS (SELECT DISTINCT series_id, ts_ns, body FROM series_events WHERE body IS NOT NULL) SELECT m.series, ts_ns, body FROM v JOIN m USING (series_id) WHERE metric = '!alarm' AND regexp_matches(body, 'degraded|\"code\":2')",
)
of_tables(
    "names_canonical",
    lambda spark, sf: table(spark, sf, "series_names").select("name_seq", canonical(F.col("name_raw")).alias("series")),
    "WITH w AS (SELECT name_seq, string_split_regex(trim(replace(name_raw, '\\ ', chr(1)), ' '), ' +') AS x FROM series_names) SELECT name_seq, CASE WHEN len(x) > 1 AND len(list_filter(x[2:], lambda t: t LIKE '_%=_%')) = len(x) - 1 THEN replace(x[1] || ' ' || list_aggregate(list_transform(list_sort(list_transform(x[2:], lambda t: replace(t, '=', chr(2)))), lambda t: replace(t, chr(2), '=')), 'string_agg', ' '), chr(1), '\\ ') END AS series FROM w",
)
of_tables(
    "late_write_accept",
    lambda spark, sf: mark_late(table(spark, sf, "input_log").select("log_seq", "id", "ts_raw"), "id", "ts_raw", "log_seq", 10_000).filter("accepted").select("log_seq", "id", "ts_raw"),
    "WITH r AS (SELECT log_seq, id, ts_raw, max(ts_raw) OVER (PARTITION BY id ORDER BY log_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM input_log WHERE id IS NOT NULL AND ts_raw IS NOT NULL) SELECT log_seq, id, ts_raw FROM r WHERE p IS NULL OR ts_raw > p",
)


def _put_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("event_type is not null and user_id is not null and ts is not null and value is not null")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    when = F.when(F.col("event_id") % 2 == 0, F.floor(us / 1_000_000).cast("bigint").cast("string")).otherwise((us * 1000).cast("string"))
    return e.select(F.concat(F.lit("put "), "event_type", F.lit(" "), when, F.lit(" "), F.col("value").cast("string"), F.lit(" user="), F.col("user_id").cast("string"), F.lit("  cohort="), (F.col("user_id") % 4).cast("string"), F.lit("\r")).alias("value"))


of_tables(
    "parse_opentsdb",
    lambda spark, sf: parse_put(_put_lines(spark, sf)),
    "SELECT event_type || ' cohort=' || (user_id % 4) || ' user=' || user_id AS series, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000000 * 1000000000 ELSE epoch_us(ts) * 1000 END AS ts_ns, value, CAST(NULL AS VARCHAR) AS error FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL",
)
of_tables(
    "parse_bulk",
    lambda spark, sf: parse_bulk(table(spark, sf, "events").select(F.concat(F.lit("ev.value|ev.k user="), F.col("user_id").cast("string"), F.lit(" type="), "event_type").alias("name"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"), F.array("value", F.get_json_object("props", "$.k").cast("double")).alias("values"))),
    "WITH e AS (SELECT 'type=' || event_type || ' user=' || user_id AS tags, epoch_us(ts) * 1000 AS ts_ns, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) SELECT 'ev.value ' || tags AS series, ts_ns, value FROM e WHERE value IS NOT NULL UNION ALL SELECT 'ev.k ' || tags, ts_ns, k FROM e WHERE k IS NOT NULL",
)
of_tables(
    "output_csv",
    lambda spark, sf: csv_lines(build(clicks(spark, sf), {"select": "click", "range": FORWARD} | fn("scale", weights=[4]))),
    S + _click() + " SELECT 'click ' || tags || ',' || strftime(make_timestamp(ts_ns // 1000), '%Y%m%dT%H%M%S') || '.' || lpad(CAST(ts_ns % 1000000000 AS VARCHAR), 9, '0') || ',' || printf('%.17g', value * 4) AS line FROM r",
)
of_tables(
    "output_resp",
    lambda spark, sf: resp_frames(build(clicks(spark, sf), _GJQ), iso=False),
    S + _over(_SPARSE, "0 AS x").rpartition(" SELECT series")[0] + " SELECT '+' || series || chr(13) || chr(10) || '+ts=' || ts_ns || chr(13) || chr(10) || '*2' || chr(13) || chr(10) || coalesce('+' || printf('%.17g', c0), '$-1') || chr(13) || chr(10) || coalesce('+' || printf('%.17g', c1), '$-1') || chr(13) || chr(10) AS line FROM j",
)


# anomalies: forecasts by recursion over the numbered buckets, sizes of errors against the length of a bucket's vector
_AN = """g AS (SELECT 'ev.value:mean type=' || t AS series, {b} AS ts_ns, avg(value) AS x FROM s WHERE metric = 'ev.value' AND {w} GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts_ns) AS i FROM g),
""".format(b=BUCKET, w=FW)
_JUDGED = """,
sized AS (SELECT *, abs(x - guess) AS size FROM f), l AS (SELECT ts_ns, sqrt(sum(size * size)) AS length FROM sized GROUP BY 1)
SELECT series, ts_ns, round(x, 6) AS value, round(guess, 6) AS forecast, coalesce(size > length * 0.7::DOUBLE, false) AS anomaly FROM sized JOIN l USING (ts_ns)"""


def _recursive(start: str, step: str, columns: str) -> str:
    return f"f AS (SELECT series, ts_ns, i, x, {start} FROM n WHERE i = 1 UNION ALL SELECT series, ts_ns, i, x, {columns} FROM (SELECT n.series, n.ts_ns, n.i, n.x, {step} FROM f JOIN n ON n.series = f.series AND n.i = f.i + 1) q)"


_MODELS = {
    "sma": ({"period": 4}, "f AS (SELECT *, CASE WHEN i > 4 THEN avg(x) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END AS guess FROM n)"),
    "ewma": ({"alpha": 0.3}, _recursive("CAST(NULL AS DOUBLE) AS guess, x AS v", "CASE WHEN n.i > 10 THEN f.v END AS guess, CASE WHEN n.i < 10 THEN f.v + n.x WHEN n.i = 10 THEN (f.v + n.x) / 10 ELSE f.v + 0.3::DOUBLE * (n.x - f.v) END AS v", "guess, v")),
    "double-exp": (
        {"alpha": 0.3, "beta": 0.2},
        _recursive("CAST(NULL AS DOUBLE) AS guess, x AS v, CAST(0 AS DOUBLE) AS m", "CASE WHEN n.i > 2 THEN f.v + f.m END AS guess, f.v AS v0, f.m AS m0, CASE WHEN n.i = 2 THEN n.x ELSE 0.7::DOUBLE * (f.v + f.m) + 0.3::DOUBLE * n.x END AS v", "guess, v, CASE WHEN i = 2 THEN v - v0 ELSE m0 + 0.2::DOUBLE * (v - v0 - m0) END"),
    ),
    "holt-winters": (
        {"alpha": 0.3, "beta": 0.2, "gamma": 0.4, "period": 4},
        _recursive(
            "CAST(NULL AS DOUBLE) AS guess, CAST(0 AS DOUBLE) AS v, CAST(0 AS DOUBLE) AS m, [x] AS season",
            "f.v AS v0, f.m AS m0, CASE WHEN n.i <= 4 THEN list_append(f.season, n.x) ELSE f.season END AS old",
            "CASE WHEN i > 4 THEN v0 + m0 + old[1] END, CASE WHEN i < 4 THEN 0 WHEN i = 4 THEN list_avg(old) ELSE 0.3::DOUBLE * (x - old[1]) + 0.7::DOUBLE * (v0 + m0) END AS v1, CASE WHEN i <= 4 THEN 0 ELSE 0.2::DOUBLE * (v1 - v0) + 0.8::DOUBLE * m0 END, CASE WHEN i < 4 THEN old WHEN i = 4 THEN list_transform(old, lambda y: y - list_avg(old)) ELSE list_append(old[2:], 0.4::DOUBLE * (x - v1) + 0.6::DOUBLE * old[1]) END",
        ),
    ),
}


def _anomaly(method: str, settings: dict[str, Any]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        buckets = build(clicks(spark, sf), {"group-aggregate": {"step": STEP, "metric": "ev.value", "func": "mean"}, "range": FORWARD, "pivot-by-tag": ["type"]})
        return _tidy(anomalies(buckets.withColumnRenamed("mean", "value"), method, 0.7, **settings), 6)

    return run


for _m, (_p, _sql) in _MODELS.items():
    of_tables("anomaly_" + _m.replace("-", "_"), _anomaly(_m, _p), S.replace("WITH e", "WITH RECURSIVE e", 1) + _AN + _sql + _JUDGED)


# the line protocol: files of frames with a dictionary, compound names and both forms of times, written and read again
def _frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("event_type is not null and ts is not null and value is not null and user_id is not null")
    types = sorted(r[0] for r in e.select("event_type").distinct().limit(MAX_ROW).collect())
    ids = {t: i for i, t in enumerate(types, 1)}
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    when = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(":"), ns.cast("string"))).otherwise(F.concat(F.lit("+"), iso_column(ns)))
    number = F.create_map(*(x for t, i in ids.items() for x in (F.lit(t), F.lit(i))))
    k = F.get_json_object("props", "$.k")
    pair = F.concat_ws("\r\n", F.concat(F.lit(":"), F.element_at(number, F.col("event_type")).cast("string")), when, F.lit("*2"), F.concat(F.lit("+"), F.col("value").cast("string")), F.concat(F.lit(":"), k))
    text = F.concat_ws("\r\n", F.concat(F.lit("+!note user="), F.col("user_id").cast("string")), when, F.concat(F.lit("$"), F.octet_length("props").cast("string")), F.col("props"))
    head = "\r\n".join([f"*{2 * len(ids)}", *(x for t, i in ids.items() for x in (f"+ev.value|ev.k type={t}", f":{i}"))])

    def with_dictionary(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if first and b.num_rows:
                first = False
                yield pa.RecordBatch.from_arrays([pa.array([head])], names=["line"])
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["line"])

    folder = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    lines = e.select(F.concat_ws("\r\n", F.when(k.isNotNull(), pair), F.when(F.col("props").isNotNull(), text)).alias("line")).filter("line <> ''")
    lines.mapInArrow(with_dictionary, "line string").write.option("lineSep", "\r\n").text(folder)
    return read_frames(spark, folder, suffix=".txt")


of_tables(
    "resp_round_trip",
    _frames,
    "WITH e AS (SELECT *, epoch_us(ts) * 1000 AS ts_ns, json_extract_string(props, '$.k') AS k FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND user_id IS NOT NULL) SELECT 'ev.value type=' || event_type AS series, ts_ns, value, CAST(NULL AS VARCHAR) AS body, CAST(NULL AS VARCHAR) AS error FROM e WHERE k IS NOT NULL UNION ALL SELECT 'ev.k type=' || event_type, ts_ns, CAST(k AS DOUBLE), NULL, NULL FROM e WHERE k IS NOT NULL UNION ALL SELECT '!note user=' || user_id, ts_ns, NULL, props, NULL FROM e WHERE props IS NOT NULL",
)


# loading: the store's samples after two batches, read back as a catalog
def _stored(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    store = Store(spark, folder)
    rows = table(spark, sf, "input_log").select(F.concat(F.lit("m  id="), F.col("id").cast("string"), F.lit(" a=1")).alias("series"), F.col("ts_raw").alias("ts_ns"), "value", F.lit(None).cast("string").alias("body"), F.col("log_seq").alias("seq"))
    half = rows.agg(F.max("seq")).first()[0] or 0
    for batch, part in enumerate((F.col("seq") <= half // 2, F.col("seq") > half // 2)):
        store.write(rows.filter(part), batch)
    return build(store.catalog(), {"select": "m", "range": {"from": 0, "to": (1 << 63) - 1}})


of_tables(
    "store_load",
    _stored,
    "WITH r AS (SELECT *, max(ts_raw) OVER (PARTITION BY id ORDER BY log_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM input_log WHERE id IS NOT NULL AND ts_raw IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)) SELECT 'm a=1 id=' || id AS series, ts_raw AS ts_ns, value FROM r WHERE (p IS NULL OR ts_raw > p) AND ts_raw >= 0",
)


def _late_stream(spark: SparkSession, sf: str) -> DataFrame:
    src, folder = _streamed(spark, sf, "input_log")
    src = src.select(F.concat(F.lit("m id="), F.col("id").cast("string")).alias("series"), F.col("ts_raw").alias("ts_ns"), F.col("log_seq").alias("seq"))
    rule = LateRule(f"{folder}/last", lambda df, batch: df.filter("accepted").select("series", "ts_ns", "seq").write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"))
    src.writeStream.foreachBatch(rule).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("series string, ts_ns bigint, seq bigint, batch bigint").parquet(f"{folder}/out").drop("batch")


of_tables(
    "stream_late_write",
    _late_stream,
    "WITH r AS (SELECT *, max(ts_raw) OVER (PARTITION BY id ORDER BY log_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM input_log WHERE id IS NOT NULL AND ts_raw IS NOT NULL) SELECT 'm id=' || id AS series, ts_raw AS ts_ns, log_seq AS seq FROM r WHERE p IS NULL OR ts_raw > p",
)
