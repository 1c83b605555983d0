"""Golden results of the request language on small series."""

import pytest
from helpers import catalog, rows

from tidewell.errors import NoData, NotFound, QueryError
from tidewell.plans.build import build, search, suggest
from tidewell.plans.catalog import rolled_up
from tidewell.plans.spec import parse


@pytest.fixture(scope="module")
def scan(spark):
    return catalog(spark, [(f"test key={k}", t, t / 10) for k in range(10) for t in range(100, 200)])


@pytest.fixture(scope="module")
def groups(spark):
    """Two metrics of eight machines in two halls: values rise by 3 per tick in hall n and fall by 2 in hall s."""
    out = []
    for metric in ("fan.speed", "fan.noise"):
        for k in range(8):
            for i in range(90):
                out.append((f"{metric} hall={'n' if k < 5 else 's'} unit={k}", 7_000 + 70 * i, 40.0 + 3 * i if k < 5 else -5.0 - 2 * i))
    return catalog(spark, out)


@pytest.fixture(scope="module")
def pair(spark):
    """Flow counts the ticks, level is 11 times as much; 26 ticks a bucket of 1300."""
    out = []
    for k in range(4):
        for i in range(78):
            out.append((f"flow side={'ab'[k % 2]} unit={k}", 500 + 50 * i, float(i)))
            out.append((f"level side={'ab'[k % 2]} unit={k}", 500 + 50 * i, 11.0 * i))
    return catalog(spark, out)


def test_forward_and_backward_ranges_are_half_open(scan):
    fw = rows(build(scan, {"select": "test", "range": {"from": 110, "to": 115}, "order-by": "time"}))
    assert [r[1] for r in fw] == [t for t in range(110, 115) for _ in range(10)]
    bw = rows(build(scan, {"select": "test", "range": {"from": 200, "to": 100}, "order-by": "time"}))
    assert [r[1] for r in bw] == [t for t in range(199, 100, -1) for _ in range(10)]
    assert bw[0][0] == "test key=9"


def test_order_by_series(scan):
    out = rows(build(scan, {"select": "test", "range": {"from": 103, "to": 100}, "order-by": "series"}))
    assert [(r[0], r[1]) for r in out[:4]] == [("test key=0", 103), ("test key=0", 102), ("test key=0", 101), ("test key=1", 103)]


def test_offset_then_limit(scan):
    q = {"select": "test", "range": {"from": 100, "to": 200}, "where": {"key": "3"}, "offset": 5, "limit": 3}
    assert [r[1] for r in rows(build(scan, q))] == [105, 106, 107]


def test_aggregate_names_and_values(groups):
    out = {r[0]: r[1:] for r in rows(build(groups, {"aggregate": {"fan.speed": "min", "fan.noise": "max"}}))}
    assert len(out) == 16
    end = 7_000 + 70 * 89
    assert out["fan.speed:min hall=n unit=0"] == (7_000, 40.0) and out["fan.speed:min hall=s unit=7"] == (end, -183.0)
    assert out["fan.noise:max hall=n unit=4"] == (end, 307.0) and out["fan.noise:max hall=s unit=5"] == (7_000, -5.0)


def test_aggregate_grouped(groups):
    out = rows(build(groups, {"aggregate": {"fan.speed": "min", "fan.noise": "max"}, "group-by": ["hall"]}))
    assert sorted((r[0], r[2]) for r in out) == [("fan.noise:max hall=n", 307.0), ("fan.noise:max hall=s", -5.0), ("fan.speed:min hall=n", 40.0), ("fan.speed:min hall=s", -183.0)]


_STEP = {"step": 1300, "metric": "flow", "func": "min"}
_FROM = {"range": {"from": 500, "to": 4400}}


def test_buckets_are_anchored_at_the_range(pair):
    out = rows(build(pair, {"group-aggregate": _STEP} | _FROM))
    assert sorted({(r[1], r[2]) for r in out}) == [(500, 0.0), (1800, 26.0), (3100, 52.0)]
    assert {r[0] for r in out} == {f"flow:min side={'ab'[k % 2]} unit={k}" for k in range(4)}


def test_buckets_of_two_functions_and_metrics(pair):
    q = {"group-aggregate": _STEP | {"metric": ["flow", "level"], "func": ["min", "max"]}, "group-by-tag": ["unit"]} | _FROM
    out = rows(build(pair, q))
    assert {r[0] for r in out} == {f"{m}:min|{m}:max side={x}" for m in ("flow", "level") for x in "ab"}
    assert {r[2:] for r in out if r[0].startswith("level")} == {(0.0, 275.0), (286.0, 561.0), (572.0, 847.0)}


def test_join_of_buckets_with_filters(pair):
    q = {"group-aggregate-join": _STEP | {"metric": ["flow", "level"]}} | _FROM
    out = rows(build(pair, q))
    assert len(out) == 12 and {r[2:] for r in out} == {(0.0, 0.0), (26.0, 286.0), (52.0, 572.0)}
    one = rows(build(pair, q | {"filter": {"flow": {"gt": 20, "lt": 50}}}))
    assert len(one) == 12 and {r[2:] for r in one} == {(None, 0.0), (26.0, 286.0), (None, 572.0)}
    both = rows(build(pair, q | {"filter": {"flow": {"gt": 20, "lt": 50}, "level": {"lt": 500}}}))
    assert {r[2:] for r in both} == {(None, 0.0), (26.0, 286.0)} and len(both) == 8


ALL = ["min", "max", "sum", "count", "min_timestamp", "max_timestamp", "mean", "last", "first", "last_timestamp", "first_timestamp"]


@pytest.fixture(scope="module")
def ties(spark):
    """Repeated values, and times that several series share."""
    return catalog(spark, [(f"m a={k} b={k % 2}", t, float((t * 7 + k * 3) % 5)) for k in range(4) for t in range(0, 300, 1 + k % 2)])


def brute_state(points):
    v, t = [p[1] for p in points], [p[0] for p in points]
    lo, hi, t0, t1 = min(v), max(v), min(t), max(t)
    at = lambda x: float(min(p[0] for p in points if p[1] == x))
    return (lo, hi, sum(v), float(len(v)), at(lo), at(hi), sum(v) / len(v), max(p[1] for p in points if p[0] == t1), min(p[1] for p in points if p[0] == t0), float(t1), float(t0))


@pytest.mark.parametrize("grouping", [{}, {"pivot-by-tag": ["b"]}])
@pytest.mark.parametrize("r", [(3, 290), (20, 260), (295, 11), (0, 999)])
def test_rollups_and_raw_rows_give_the_same_as_brute_force(spark, ties, grouping, r):
    data = [(s.series, x.ts_ns, x.value) for s in ties.series.collect() for x in ties.samples.filter(f"series_id = {s.series_id}").collect()]
    name = lambda s: "b=" + s[-1] if grouping else s[2:]
    begin, end = r
    inside = [x for x in data if (begin <= x[1] < end if begin < end else end < x[1] <= begin)]
    bucket = lambda t: begin + (t - begin) // 20 * 20 if begin < end else begin - (begin - t) // 20 * 20
    cells, wholes = {}, {}
    for s, t, v in inside:
        cells.setdefault((name(s), bucket(t)), []).append((t, v))
        wholes.setdefault(name(s), []).append((t, v))
    for cat in (ties, rolled_up(ties, 10)):
        q = {"group-aggregate": {"step": 20, "metric": "m", "func": ALL}, "range": {"from": begin, "to": end}} | grouping
        assert {(x[0].split(" ", 1)[1], x[1]): pytest.approx(x[2:]) for x in rows(build(cat, q))} == {k: brute_state(p) for k, p in cells.items()}
        for f in ("min", "max_timestamp", "last", "sum"):
            got = {x[0].split(" ", 1)[1]: x[2] for x in rows(build(cat, {"aggregate": {"m": f}, "range": {"from": begin, "to": end}} | grouping))}
            assert got == {k: pytest.approx(brute_state(p)[ALL.index(f)]) for k, p in wholes.items()}
    assert rows(build(rolled_up(ties, 10), {"aggregate": {"m": "count"}})) != []


def test_aggregates_never_sort_raw_rows(ties):
    def plan(q):
        return build(ties, q)._jdf.queryExecution().executedPlan().toString()

    r = {"range": {"from": 0, "to": 300}}
    for q in [{"aggregate": {"m": f}} for f in ALL] + [{"group-aggregate": {"step": 10, "metric": "m", "func": [f for f in ALL if not f.endswith("in_timestamp") and not f.endswith("ax_timestamp")]}}]:
        # the dimension may be sorted, it has one row per series
        assert not [x for x in plan(q | r).split("\n") if "SortAggregate" in x and "tag_key" in x], q


def test_join_needs_series_of_the_first_metric_only(spark):
    c = catalog(spark, [("a h=1", 1, 1), ("a h=1", 2, 2), ("b h=1", 2, 20), ("b h=1", 3, 30), ("b h=2", 2, 99)])
    assert sorted(rows(build(c, {"join": ["a", "b"], "range": {"from": 0, "to": 9}}))) == [("a|b h=1", 1, 1.0, None), ("a|b h=1", 2, 2.0, 20.0), ("a|b h=1", 3, None, 30.0)]
    assert sorted(rows(build(c, {"join": ["b", "nothing"], "range": {"from": 0, "to": 9}, "where": {"h": "1"}}))) == [("b|nothing h=1", 2, 20.0, None), ("b|nothing h=1", 3, 30.0, None)]


def test_exact_names_ignore_incomplete_ones(spark):
    c = catalog(spark, [(f"test key={k} zzz=0", t, t) for k in range(9) for t in (100, 101)])
    q = {"select": "test", "range": {"from": 100, "to": 200}, "where": [{"key": "1", "zzz": "0"}, {"zzz": 0, "key": 2}, {"key": "3"}]}
    assert {r[0] for r in rows(build(c, q))} == {"test key=1 zzz=0", "test key=2 zzz=0"}


def test_grouping_drops_series_without_the_tag_and_names_without_tags(spark):
    c = catalog(spark, [("m a=1 b=1", 1, 1), ("m b=2", 2, 2), ("m a=2", 3, 3)])
    assert rows(build(c, {"select": "m", "range": {"from": 0, "to": 9}, "group-by-tag": "a"})) == [("m b=1", 1, 1.0)]
    assert sorted(rows(build(c, {"select": "m", "range": {"from": 0, "to": 9}, "group-by-tag": ["zz"]}))) == [("m a=1 b=1", 1, 1.0), ("m a=2", 3, 3.0), ("m b=2", 2, 2.0)]
    with pytest.raises(NoData):
        build(c, {"select": "m", "range": {"from": 0, "to": 9}, "pivot-by-tag": ["zz"]})


def test_events_by_partial_match(spark):
    c = catalog(spark, [("x a=1", 1, 1)], [("!foo a=1", 5, "disk full"), ("!foo a=1", 6, "disk ok\nline"), ("!foo a=2", 7, "")])
    out = rows(build(c, {"select-events": "!foo", "range": {"from": 0, "to": 9}, "filter": "ok|full$", "order-by": "time"}))
    assert out == [("!foo a=1", 5, "disk full"), ("!foo a=1", 6, "disk ok\nline")]


def test_ties_of_least_and_greatest_go_to_the_earliest(spark):
    c = catalog(spark, [("m a=1", t, v) for t, v in ((1, 5), (2, 3), (3, 3), (4, 5), (5, float("inf")), (6, float("-inf")))])
    assert rows(build(c, {"aggregate": {"m": "min"}, "range": {"from": 1, "to": 5}})) == [("m:min a=1", 2, 3.0)]
    assert rows(build(c, {"aggregate": {"m": "max"}, "range": {"from": 1, "to": 5}})) == [("m:max a=1", 1, 5.0)]
    assert rows(build(c, {"aggregate": {"m": "max"}})) == [("m:max a=1", 5, float("inf"))]


def test_backward_buckets(spark):
    c = catalog(spark, [("m a=1", t, t) for t in range(0, 31)])
    out = sorted(rows(build(c, {"group-aggregate": {"step": 10, "metric": "m", "func": ["min", "max", "count"]}, "range": {"from": 30, "to": 5}})))
    assert out == [("m:min|m:max|m:count a=1", 10, 6.0, 10.0, 5.0), ("m:min|m:max|m:count a=1", 20, 11.0, 20.0, 10.0), ("m:min|m:max|m:count a=1", 30, 21.0, 30.0, 10.0)]


def test_empty_range_and_unknown_names(scan):
    for q in ({"select": "test"}, {"aggregate": {"test": "sum"}}, {"group-aggregate": {"step": 5, "metric": "test", "func": "sum"}}, {"join": ["test", "test"]}):
        assert rows(build(scan, q | {"range": {"from": 5000, "to": 6000}})) == []
    for q in ({"select": "none"}, {"aggregate": {"none": "sum"}}, {"group-aggregate": {"step": 5, "metric": "none", "func": "sum"}}, {"join": ["none", "test"]}):
        with pytest.raises(NotFound):
            build(scan, q | {"range": {"from": 0, "to": 6000}})


def test_metadata(groups):
    assert len(rows(build(groups, {"select": "meta:names"}))) == 16
    assert len(rows(build(groups, {"select": "meta:names:fan.speed", "where": {"hall": ["n"]}}))) == 5
    assert rows(suggest(groups, {"select": "metric-names", "starts-with": "fan.s"})) == [("fan.speed",)]
    assert sorted(rows(suggest(groups, {"select": "tag-names", "metric": "fan.speed"}))) == [("hall",), ("unit",)]
    assert sorted(rows(suggest(groups, {"select": "tag-values", "metric": "fan.speed", "tag": "unit", "starts-with": "7"}))) == [("7",)]
    assert len(rows(search(groups, {"select": "", "where": {"unit": "1"}}))) == 2


BAD = [
    '{"select": "meta:names", "apply": [{"name": "abs"}]}',
    '{"select": "meta:names", "order-by": "time"}',
    '{"select": "meta:names", "range": {"from": 1, "to": 2}}',
    '{"select": ',
    '["select"]',
    '{"range": {"from": 1, "to": 2}}',
    '{"select": "m"}',
    '{"select": "m", "join": ["a", "b"], "range": {"from": 1, "to": 2}}',
    '{"select": "!m", "range": {"from": 1, "to": 2}}',
    '{"select": "m", "range": {"from": 1}}',
    '{"select": "m", "range": {"from": "2006-01-02", "to": 2}}',
    '{"select": "m", "range": {"from": 1, "to": 2}, "sample": "all"}',
    '{"select": "m", "range": {"from": 1, "to": 2}, "limit": -1}',
    '{"select": "m", "range": {"from": 1, "to": 2}, "order-by": "value"}',
    '{"select": "m", "range": {"from": 1, "to": 2}, "filter": {"gt": "x"}}',
    '{"select": "m", "range": {"from": 1, "to": 2}, "filter": {"gt": 5, "lt": 1}}',
    '{"select": "m", "range": {"from": 1, "to": 2}, "filter": {"other": {"gt": 1}}}',
    '{"select": "m", "range": {"from": 1, "to": 2}, "where": ["a"]}',
    '{"select": "m", "range": {"from": 1, "to": 2}, "group-by-tag": ["a"], "pivot-by-tag": ["b"]}',
    '{"select": "m", "select": "n", "range": {"from": 1, "to": 2}}',
    '{"select-events": "m", "range": {"from": 1, "to": 2}}',
    '{"aggregate": {"m": "avg"}}',
    '{"aggregate": {"m": "min"}, "order-by": "time"}',
    '{"aggregate": {"m": "min"}, "filter": {"gt": 1}}',
    '{"group-aggregate": {"step": "0s", "metric": "m", "func": "min"}, "range": {"from": 1, "to": 2}}',
    '{"group-aggregate": {"step": "1x", "metric": "m", "func": "min"}, "range": {"from": 1, "to": 2}}',
    '{"group-aggregate": {"step": "1s", "metric": "m", "func": "cnt"}, "range": {"from": 1, "to": 2}}',
    '{"group-aggregate": {"step": "1s", "metric": "m", "func": ["min", "sum"]}, "range": {"from": 1, "to": 2}, "filter": {"sum": {"gt": 1}}}',
    '{"group-aggregate-join": {"step": "1s", "metric": ["m", "n"], "func": ["min", "max"]}, "range": {"from": 1, "to": 2}}',
    '{"group-aggregate-join": {"step": "1s", "metric": ["m"], "func": "min"}, "range": {"from": 1, "to": 2}}',
    '{"group-aggregate-join": {"step": "1s", "metric": ["m", "n"], "func": "min"}, "range": {"from": 1, "to": 2}, "pivot-by-tag": ["a"]}',
    '{"join": ["m"], "range": {"from": 1, "to": 2}}',
    '{"join": ["m", "n"], "range": {"from": 1, "to": 2}, "group-by-tag": ["a"]}',
    '{"select": "m", "range": {"from": 1, "to": 2}, "output": {"format": "xml"}}',
]


@pytest.mark.parametrize("text", BAD)
def test_bad_requests(text):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert e.value.line().startswith("-") and "\n" not in e.value.line()
