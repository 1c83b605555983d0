"""Query requests (JSON) parsed into frozen specifications, with the checks that need no data."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from dataclasses import field as dc_field
from typing import Any

from tidewell.errors import QueryError
from tidewell.functions.timefmt import parse_duration, parse_timestamp

# Names of aggregates, statements and clauses of the request language.
AGGREGATES = ("min", "max", "sum", "count", "min_timestamp", "max_timestamp", "mean", "last", "first", "last_timestamp", "first_timestamp")
STATEMENTS = ("select", "select-events", "aggregate", "group-aggregate", "join", "group-aggregate-join")
CLAUSES = ("range", "where", "filter", "group-by-tag", "pivot-by-tag", "group-by", "order-by", "limit", "offset", "apply", "output")
#: Aggregates that a filter on buckets may name.
FILTERABLE = ("min", "max", "mean")


@dataclass(frozen=True)
class Range:
    """Half-open: [begin, end) forward, (end, begin] backward."""

    begin: int
    end: int

    @property
    def backward(self) -> bool:
        return self.begin > self.end


@dataclass(frozen=True)
class Bounds:
    """Limits on a value. An exclusive limit wins over an inclusive one on the same side."""

    gt: float | None = None
    lt: float | None = None
    ge: float | None = None
    le: float | None = None

    def check(self, what: str) -> Bounds:
        low = self.gt if self.gt is not None else self.ge
        high = self.lt if self.lt is not None else self.le
        if low is None and high is None:
            raise QueryError(f"filter of {what} has no limit")
        if low is not None and high is not None and not low < high:
            raise QueryError(f"filter of {what} has a lower limit that isn't below the upper one")
        return self


@dataclass(frozen=True)
class Query:
    """A parsed request. ``columns``: (metric, aggregate or None) of each statement column."""

    kind: str
    metrics: tuple[str, ...] = ()
    functions: tuple[str, ...] = ()
    step: int = 0
    range: Range | None = None
    where: tuple[tuple[str, tuple[str, ...]], ...] = ()
    exact: tuple[tuple[tuple[str, str], ...], ...] = ()
    filters: tuple[tuple[str, Bounds], ...] = ()
    any_filter: bool = False
    regex: str | None = None
    tags: tuple[str, ...] = ()
    keep_tags: bool = False
    order: str | None = None
    limit: int | None = None
    offset: int = 0
    apply: tuple[Mapping[str, Any], ...] = ()
    format: str = "resp"
    iso: bool = True
    starts_with: str = ""
    tag: str | None = dc_field(default=None)


def load(request: str | Mapping[str, Any]) -> dict[str, Any]:
    """JSON text or an already parsed object."""
    if isinstance(request, Mapping):
        return dict(request)

    def once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise QueryError("a key occurs twice in one object")
        return out

    try:
        out = json.loads(request, object_pairs_hook=once)
    except ValueError as e:
        raise QueryError(f"the request isn't JSON: {e}") from None
    if not isinstance(out, dict):
        raise QueryError("the request isn't an object")
    return out


def _texts(value: Any, what: str) -> tuple[str, ...]:
    items = value if isinstance(value, list) else [value]
    if not items or any(isinstance(x, (dict, list)) or x is None or x == "" for x in items):
        raise QueryError(f"{what} needs a name or a list of names")
    return tuple(str(x) for x in items)


def _number(value: Any, what: str) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        raise QueryError(f"{what}: {value!r} is no number") from None


def _count(value: Any, what: str) -> int:
    s = str(value)
    if isinstance(value, bool) or not s.isdigit():
        raise QueryError(f"{what} must be a non-negative integer")
    return int(s)


def _range(value: Any) -> Range:
    if not isinstance(value, dict) or set(value) != {"from", "to"}:
        raise QueryError("range needs from and to")
    return Range(parse_timestamp(value["from"]), parse_timestamp(value["to"]))


def _where(value: Any) -> dict[str, Any]:
    if isinstance(value, dict):
        return {"where": tuple((k, _texts(v, f"where {k}")) for k, v in value.items())}
    if isinstance(value, list) and value and all(isinstance(x, dict) and x for x in value):
        return {"exact": tuple(tuple(sorted((k, _texts(v, k)[0]) for k, v in x.items())) for x in value)}
    raise QueryError("where must be an object or a list of objects")


def _bounds(value: Mapping[str, Any], what: str) -> Bounds:
    if unknown := set(value) - {"gt", "lt", "ge", "le"}:
        raise QueryError(f"filter of {what} has an unknown key {sorted(unknown)[0]}")
    return Bounds(**{k: _number(v, f"filter {k}") for k, v in value.items()}).check(what)


def _filter(value: Any, names: tuple[str, ...]) -> dict[str, Any]:
    if not isinstance(value, dict) or not value:
        raise QueryError("filter must be an object")
    if not any(isinstance(v, dict) for v in value.values()):
        if len(names) != 1:
            raise QueryError("a filter without names needs a single column")
        return {"filters": ((names[0], _bounds(value, names[0])),)}
    out: list[tuple[str, Bounds]] = []
    some = False
    for name, v in value.items():
        if name == "=":
            if not isinstance(v, dict) or set(v) != {"require"} or v["require"] not in ("all", "any"):
                raise QueryError('filter "=" must be {"require": "all" | "any"}')
            some = v["require"] == "any"
        elif name not in names or not isinstance(v, dict):
            raise QueryError(f"filter names {name}, which isn't a column of the query")
        else:
            out.append((name, _bounds(v, name)))
    if not out:
        raise QueryError("filter has no limits")
    return {"filters": tuple(out), "any_filter": some and len(out) > 1}


def _grouping(req: Mapping[str, Any]) -> dict[str, Any]:
    used = [k for k in ("group-by-tag", "pivot-by-tag", "group-by") if k in req]
    if len(used) > 1:
        raise QueryError("only one grouping clause is allowed")
    if not used:
        return {}
    # the short form is an old name of pivot-by-tag
    return {"tags": _texts(req[used[0]], used[0]), "keep_tags": used[0] != "group-by-tag"}


def _output(value: Any) -> dict[str, Any]:
    if not isinstance(value, dict) or set(value) - {"format", "timestamp"}:
        raise QueryError("output may have format and timestamp")
    form, ts = str(value.get("format", "resp")).lower(), str(value.get("timestamp", "iso")).lower()
    if form not in ("resp", "csv") or ts not in ("iso", "raw"):
        raise QueryError("output knows the formats resp and csv and the timestamps iso and raw")
    return {"format": form, "iso": ts == "iso"}


def _apply(value: Any) -> tuple[Mapping[str, Any], ...]:
    steps = value if isinstance(value, list) else [value]
    if not steps or any(not isinstance(s, dict) or not isinstance(s.get("name"), str) for s in steps):
        raise QueryError("apply needs a list of objects with a name")
    return tuple(dict(s) for s in steps)


def _metric(name: Any, event: bool = False) -> str:
    if not isinstance(name, str) or not name or name.startswith("!") != event:
        raise QueryError("an event name starts with '!'" if event else "a metric name must be a text that doesn't start with '!'")
    return name


def _aggregates(names: tuple[str, ...]) -> tuple[str, ...]:
    for f in names:
        if f not in AGGREGATES:
            raise QueryError(f"unknown aggregate {f}")
    if len(set(names)) < len(names):
        raise QueryError("an aggregate occurs twice")
    return names


def _statement(req: Mapping[str, Any]) -> dict[str, Any]:
    kinds = [k for k in STATEMENTS if k in req]
    if len(kinds) != 1:
        raise QueryError("a query has exactly one statement")
    kind, body = kinds[0], req[kinds[0]]
    if kind == "select":
        if isinstance(body, str) and (body == "meta:names" or body.startswith("meta:names:")):
            return {"kind": "names", "metrics": (body[len("meta:names:") :],) if ":" in body[5:] else ()}
        return {"kind": kind, "metrics": (_metric(body),)}
    if kind == "select-events":
        return {"kind": kind, "metrics": (_metric(body, True),)}
    if kind == "join":
        if not isinstance(body, list) or len(body) < 2:
            raise QueryError("join needs a list of two or more metrics")
        return {"kind": kind, "metrics": tuple(_metric(m) for m in body)}
    if not isinstance(body, dict) or not body:
        raise QueryError(f"{kind} needs an object")
    if kind == "aggregate":
        return {"kind": kind, "metrics": tuple(_metric(m) for m in body), "functions": tuple(_aggregates(_texts(f, m))[0] for m, f in body.items())}
    if set(body) != {"step", "metric", "func"}:
        raise QueryError(f"{kind} needs step, metric and func")
    step = parse_duration(body["step"])
    if not step:
        raise QueryError("step must be longer than nothing")
    metrics, funcs = tuple(_metric(m) for m in _texts(body["metric"], "metric")), _aggregates(_texts(body["func"], "func"))
    if kind == "group-aggregate-join" and (len(metrics) < 2 or len(funcs) != 1):
        raise QueryError("group-aggregate-join needs two or more metrics and one func")
    if kind == "group-aggregate" and len(set(metrics)) < len(metrics):
        raise QueryError("a metric occurs twice")
    return {"kind": kind, "metrics": metrics, "functions": funcs, "step": step}


def parse(request: str | Mapping[str, Any]) -> Query:
    """A query request."""
    req = load(request)
    made = _statement(req)
    kind = made["kind"]
    if unknown := set(req) - {*STATEMENTS, *CLAUSES}:
        raise QueryError(f"unknown key {sorted(unknown)[0]}")
    if kind == "names" and (unused := {"apply", "order-by", "range"} & set(req)):
        raise QueryError(f"names of series take no {sorted(unused)[0]}")
    if "range" in req:
        made["range"] = _range(req["range"])
    elif kind not in ("aggregate", "names"):
        raise QueryError(f"{kind} needs a range")
    if "where" in req:
        made |= _where(req["where"])
    made |= _grouping(req)
    if made.get("tags") and kind in ("join", "group-aggregate-join", "names"):
        raise QueryError(f"{kind} can't be grouped by tag")
    if "filter" in req:
        if kind in ("aggregate", "names"):
            raise QueryError(f"{kind} takes no filter")
        if kind == "select-events":
            if not isinstance(req["filter"], str):
                raise QueryError("events are filtered by a regular expression")
            made["regex"] = req["filter"]
        else:
            made |= _filter(req["filter"], made["functions"] if kind == "group-aggregate" else made["metrics"])
    if kind == "group-aggregate":
        for name, _ in made.get("filters", ()):
            if name not in FILTERABLE:
                raise QueryError(f"buckets can't be filtered by {name}")
    if "order-by" in req:
        if kind == "aggregate" or req["order-by"] not in ("time", "series"):
            raise QueryError("order-by is time or series, and aggregate takes none")
        made["order"] = req["order-by"]
    for k in ("limit", "offset"):
        if k in req:
            made[k] = _count(req[k], k)
    if "apply" in req:
        made["apply"] = _apply(req["apply"])
    if "output" in req:
        made |= _output(req["output"])
    return Query(**made)


def parse_suggest(request: str | Mapping[str, Any]) -> Query:
    """A request for metric names, tag names or tag values, by prefix."""
    req = load(request)
    kind = req.get("select")
    need = {"metric-names": set(), "tag-names": {"metric"}, "tag-values": {"metric", "tag"}}
    if kind not in need:
        raise QueryError("suggest offers metric-names, tag-names and tag-values")
    if unknown := set(req) - {"select", "metric", "tag", "starts-with", "output"}:
        raise QueryError(f"unknown key {sorted(unknown)[0]}")
    if missing := need[kind] - set(req):
        raise QueryError(f"{kind} needs {sorted(missing)[0]}")
    out = {"kind": kind, "metrics": (str(req["metric"]),) if "metric" in req else (), "tag": req.get("tag"), "starts_with": str(req.get("starts-with", ""))}
    return Query(**out | (_output(req["output"]) if "output" in req else {}))


def parse_search(request: str | Mapping[str, Any]) -> Query:
    """A request for series names by metric (or "" for all) and tags."""
    req = load(request)
    if not isinstance(req.get("select"), str):
        raise QueryError("search needs select with a metric or an empty text")
    if unknown := set(req) - {"select", "where", "limit", "offset", "output"}:
        raise QueryError(f"unknown key {sorted(unknown)[0]}")
    out: dict[str, Any] = {"kind": "search", "metrics": (req["select"],) if req["select"] else ()}
    if "where" in req:
        out |= _where(req["where"])
    for k in ("limit", "offset"):
        if k in req:
            out[k] = _count(req[k], k)
    return Query(**out | (_output(req["output"]) if "output" in req else {}))
