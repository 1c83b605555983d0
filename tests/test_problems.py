"""The general data problems against brute force, with dirty, empty and skewed input."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidewell.operators import common, late_events, regular_grid, spikes, trailing
from tidewell.operators.late_write import mark_late
from tidewell.plans import problem_queries

H = 3_600_000_000_000
DAY = 24 * H
NAN, INF = float("nan"), float("inf")


# late events
def at(us):
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)


LOG = "id bigint, ts_raw bigint, value double, arrived_at timestamp, key string, period_ns int"


def log(spark, data):
    """Rows with further columns whose names clash with those of the operator."""
    return spark.createDataFrame([(*r, "x", 7) for r in data], LOG)


def test_late_points_correct_their_period_until_it_closes(spark):
    t0 = 400_000 * H
    end_us, cut = (t0 + H) // 1000, 1_800_000_000
    data = [
        (1, t0 + 5, 1.0, at(end_us - 1)),  # in time
        (1, t0 + 6, 2.0, at(end_us)),  # late by nothing: late
        (1, t0 + 7, 4.0, at(end_us + cut)),  # at the closing: accepted
        (1, t0 + 8, 8.0, at(end_us + cut + 1)),  # refused
        (1, t0 + 6, 2.0, at(end_us + 10**9)),  # sent again
        (1, t0 + 9, NAN, at(end_us)),
        (1, t0 + 9, None, at(end_us)),
        (1, None, 1.0, at(end_us)),
        (1, t0 + 9, 1.0, None),
        (None, t0 + 9, 1.0, at(end_us)),
        (2, t0 // 10**9, 16.0, at(end_us - 5)),  # in seconds
        (3, t0, 1.0, at(end_us)),  # no cut-off
    ]
    cutoffs = spark.createDataFrame([(1, cut), (2, cut)], "key bigint, cutoff_us bigint")
    parts = late_events.partials(late_events.judged(late_events.points(log(spark, data)), cutoffs))
    got = sorted(rows(late_events.combine(parts).select("key", "period_ns", "n", "total", "least", "most", "n_late")))
    assert got == [(1, t0, 3, 7.0, 1.0, 4.0, 2), (2, t0, 1, 16.0, 16.0, 16.0, 0)]
    before = sorted(rows(late_events.combine(parts, as_of_us=end_us - 1).select("key", "n")))
    assert before == [(1, 1), (2, 1)]
    assert rows(late_events.combine(late_events.partials(late_events.judged(late_events.points(log(spark, [])), cutoffs)))) == []


def test_units_of_time(spark):
    ns = 1_231_113_600_123_456_789
    df = spark.createDataFrame([(ns // d,) for d in (1, 10**3, 10**6, 10**9)], "t bigint")
    assert [r[0] for r in df.select(late_events.to_ns(F.col("t"))).collect()] == [ns // d * d for d in (1, 10**3, 10**6, 10**9)]


def test_dimension_joins_by_salt_beyond_the_bound(spark):
    facts = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 0), (9, 0)], "k bigint, x bigint")
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k bigint, name string")
    for how, n in (("inner", 101), ("left", 102)):
        a = common.attach_dimension(facts, dim, "k", ["x"], how)
        b = common.attach_dimension(facts, dim, "k", ["x"], how, max_rows=1)
        assert sorted(rows(a), key=str) == sorted(rows(b), key=str) and b.count() == n


# trailing totals
def brute_trailing(data, n):
    keep = {}
    for k, t, v in {(k, t, v) for k, t, v in data if k is not None and t is not None and v is not None and not math.isnan(v)}:
        keep.setdefault(k, {}).setdefault(t // DAY, []).append(v)
    out = {}
    for k, days in keep.items():
        for d in range(min(days), max(days) + 1):
            out[k, d] = sum(sum(days.get(x, [])) for x in range(d - n + 1, d + 1))
    return out


@pytest.mark.parametrize("n", [1, 7, 13, 30])
def test_trailing_totals_match_brute_force(spark, n):
    rng = random.Random(n)
    data = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([0, 3, 8, 9, 15, 60]) * DAY + rng.randrange(-DAY * 3, DAY * 9), float(rng.randrange(50))) for _ in range(300)]
    data += data[:20] + [(1, 5, None), (1, 6, NAN), (None, 5, 1.0), (1, None, 1.0)]
    df = spark.createDataFrame([(*r, "clash") for r in data], "series_id bigint, ts_ns bigint, value double, day string")
    got = {(r.key, r.day): r[f"t{n}"] for r in trailing.trailing(trailing.daily_totals(df), (n,)).collect()}
    assert got == brute_trailing(data, n)


def test_infinite_values_leave_the_window(spark):
    df = spark.createDataFrame([(1, 0, INF), (1, 10 * DAY, 2.0)], "series_id bigint, ts_ns bigint, value double")
    got = {r.day: r.t7 for r in trailing.trailing(trailing.daily_totals(df), (7,)).collect()}
    assert got[0] == got[6] == INF and got[7] == 0.0 and got[10] == 2.0
    assert rows(trailing.trailing(trailing.daily_totals(df.limit(0)))) == []
    with pytest.raises(ValueError):
        trailing.trailing(trailing.daily_totals(df), (0,))


# regular grid
GRID = "series_id bigint, ts_ns bigint, value double, step_ns bigint, slot string, key string"


def grid_input(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], GRID)


def brute_grid(data, h=1.5, min_support=1.5):
    series = {}
    for k, t, v, s in set(data):
        series.setdefault((k, s), []).append((t, v))
    out = {}
    for (k, s), pts in series.items():
        have = sorted({t // s for t, _ in pts})
        slots = set(have)
        for a, b in zip(have, have[1:], strict=False):
            if (b - a - 1) * s <= 10 * DAY:
                slots |= set(range(a, b))
        for slot in slots:
            near = [((t - slot * s) / s - 0.5, v) for t, v in pts if math.isfinite(v)]
            near = [(d, 1 - (d / h) ** 2, v) for d, v in near if abs(d) < h]
            n = sum(t // s == slot for t, _ in pts)
            w, ww = sum(x[1] for x in near), sum(x[1] ** 2 for x in near)
            sup = w * w / ww if ww else 0.0
            value = None
            if w > 0 and (n or sup >= min_support):
                wd, wdd = sum(x[1] * x[0] for x in near), sum(x[1] * x[0] ** 2 for x in near)
                wy, wdy = sum(x[1] * x[2] for x in near), sum(x[1] * x[0] * x[2] for x in near)
                det = w * wdd - wd * wd
                value = (wdd * wy - wd * wdy) / det if det > 1e-6 * w * w else wy / w
            out[k, slot * s] = (value, n, sup, n == 0)
    return out


def test_grid_matches_brute_force(spark):
    rng = random.Random(5)
    data = []
    for k, s in ((1, 1000), (2, 7000), (3, DAY)):
        t = -3 * s
        for _ in range(400):
            t += rng.choice([s // 3, s, s, s + s // 7, 6 * s, 700 * s if rng.random() < 0.05 else s])
            data.append((k, t, rng.choice([INF, 3.4e38, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)]) if rng.random() < 0.1 else rng.gauss(5, 1), s))
    dirty = [*data, *data[:50], (1, 5, None, 1000), (1, 6, NAN, 1000), (None, 5, 1.0, 1000), (1, None, 1.0, 1000), (7, 5, 1.0, None), (7, 5, 1.0, 0)]
    want = brute_grid(data)
    got = {(r.key, r.slot_ns): (r.value, r.n_readings, r.support, r.missing) for r in regular_grid.grid(grid_input(spark, dirty)).collect()}
    assert got.keys() == want.keys()
    for k, (v, n, sup, miss) in want.items():
        g = got[k]
        assert g[1] == n and g[3] == miss and g[2] == pytest.approx(sup)
        assert (g[0] is None) == (v is None) and (v is None or g[0] == pytest.approx(v, rel=1e-6, abs=1e-6))
    empty = {(r.key, r.slot * r.step) for r in regular_grid.empty_slots(grid_input(spark, dirty)).collect()}
    assert empty == {k for k, v in want.items() if v[3]}
    assert rows(regular_grid.grid(grid_input(spark, []))) == []


def test_gaps_across_blocks_and_outages(spark):
    s = 60_000_000_000
    many = regular_grid.BLOCK * 3
    data = [(1, 0, 1.0, s), (1, many * s, 1.0, s), (1, many * s + 20 * DAY, 1.0, s)]
    got = [r.slot_ns for r in regular_grid.found_empty(regular_grid.grid(grid_input(spark, data))).orderBy("slot_ns").collect()]
    assert got == [i * s for i in range(1, many)]


def test_empty_slots_are_filled_from_both_sides_only(spark, tmp_path):
    s = 1000
    # slots 0 and 5 hold two readings each that lie close together, slots 1 to 4 none; slot 7 lies between readings
    data = [(1, 900, 1.0), (1, 950, 2.0), (1, 5050, 5.0), (1, 5100, 7.0), (1, 6500, 4.0), (1, 8500, 8.0)]
    spark.createDataFrame([(1, "m", s)], "series_id bigint, metric string, step_ns bigint").write.parquet(str(tmp_path / "series_dim.parquet"))
    spark.createDataFrame([("m", "gauge", 0.0, 9.0, 0)], "metric string, kind string, lo double, hi double, late_cutoff_s int").write.parquet(str(tmp_path / "metric_defs.parquet"))
    spark.createDataFrame(data, "series_id bigint, ts_ns bigint, value double").write.parquet(str(tmp_path / "samples.parquet"))
    got = {r.slot_ns // s: r for r in problem_queries.p3_grid(spark, str(tmp_path)).collect()}
    assert {k for k, r in got.items() if r.missing} == {1, 2, 3, 4, 7}
    assert {k for k, r in got.items() if r.filled} == {7} and got[7].value == pytest.approx(6.0)
    assert all(got[k].value is None for k in (1, 2, 3, 4)) and 1 <= got[0].value <= 2


# spikes
def readings(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data], "series_id bigint, ts_ns bigint, value double, step_ns bigint, lo double, hi double, piece string")


def noisy(n, seed):
    rng = np.random.default_rng(seed)
    return 100 + 5 * np.sin(np.arange(n) / 24 * 2 * np.pi) + rng.normal(0, 1, n)


def flagged(spark, values, lo=0.0, hi=1000.0, **kw):
    data = [(1, i * 1000, None if v is None else float(v), 1000, lo, hi) for i, v in enumerate(values)]
    return {r.ts // 1000: (r.impossible, r.stuck, r.spike) for r in spikes.implausible(readings(spark, data), **kw).collect()}


def test_spikes_stuck_and_impossible_values_are_told_from_normal_ones(spark):
    v = noisy(1200, 1)
    v[200], v[400], v[401], v[402] = 180, 160, 170, 150
    v[500:512] = v[500]
    v[600], v[601] = INF, 2000
    v[800:] += 60  # a lasting change
    v[1000:1005] += 90  # five readings are no short excursion
    got = flagged(spark, v)
    assert {k for k, f in got.items() if f[2]} == {200, 400, 401, 402}
    assert {k for k, f in got.items() if f[1]} == set(range(500, 512))
    assert {k for k, f in got.items() if f[0]} == {600, 601}


def test_pieces_give_what_the_whole_series_gives(spark):
    v = noisy(5000, 2)
    for i in range(90, 5000, 113):
        v[i] += 40
    for i in range(500, 5000, 1000):
        v[i : i + 14] = v[i]
    whole = flagged(spark, v)
    assert flagged(spark, v, piece=512, halo=128) == whole and len(whole) > 100


def test_runs_over_many_pieces_are_stuck_as_in_the_whole_series(spark):
    v = noisy(3000, 4)
    v[700:1900] = v[700]  # longer than a piece and both halos
    v[2200:2205] = v[2200]  # short, over the end of a piece
    v[2556:2566] = v[2556]  # ten readings, over the end of a piece
    v[2950:] = v[2950]  # hangs at its end and fills the last piece
    want = {*range(700, 1900), *range(2556, 2566), *range(2950, 3000)}
    for kw in ({}, {"piece": 512, "halo": 128}, {"piece": 64, "halo": 16}, {"piece": 50, "halo": 10}):
        assert {k for k, f in flagged(spark, v, **kw).items() if f[1]} == want


def test_series_whose_readings_repeat_are_not_stuck(spark):
    rng = random.Random(3)
    v = [float(rng.random() < 0.02) for _ in range(800)]
    assert flagged(spark, v, hi=1.0) == {}
    assert flagged(spark, [5.0] * 300) == {}


def test_long_runs_that_are_the_normal_state_are_not_stuck(spark):
    v = []
    for i in range(12):  # a door: long runs, few other pairs, and those mostly changes
        v += [float(i % 2)] * (20 + i)
    v += [0.0, 1.0]
    assert flagged(spark, v, hi=1.0) == {}
    w = noisy(400, 5)
    w[100:130], w[200:212], w[390:] = w[100], w[200], w[390]
    assert {k for k, f in flagged(spark, w).items() if f[1]} == {*range(100, 130), *range(200, 212), *range(390, 400)}


def test_dirty_and_tiny_series(spark):
    assert flagged(spark, []) == {}
    assert flagged(spark, [1.0, None, NAN, -5.0]) == {3: (True, False, False)}
    data = [(1, 5, 2000.0, None, None, None), (1, 5, 2000.0, None, None, None), (None, 5, 1.0, 1, 0.0, 1.0), (2, 5, -INF, 1, None, None)]
    assert sorted(rows(spikes.implausible(readings(spark, data)).select("key", "ts"))) == [(2, 5)]


# the append-only rule
def test_late_writes(spark):
    rng = random.Random(9)
    data = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(200)]), i) for i in range(600)]
    df = spark.createDataFrame(data, "series string, ts_ns bigint, seq bigint")
    last, want = {}, []
    for s, t, i in data:
        if s is not None and t is not None and (s not in last or t > last[s]):
            last[s] = t
            want.append(i)
    for block in (7, 10**6):
        assert [r.seq for r in mark_late(df, block=block).filter("accepted").orderBy("seq").collect()] == want
        assert mark_late(df, block=block).count() == 600
