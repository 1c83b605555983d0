"""The apply functions, expressions, names, times and words."""

import math

import pytest
from helpers import catalog, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.errors import QueryError
from tidewell.functions import names, ordered, sax, timefmt
from tidewell.functions.apply import Frame, run_steps
from tidewell.functions.apply import FUNCTIONS, Frame
from tidewell.functions.expr import compile_expression
from tidewell.plans.build import build

R = {"from": 0, "to": 10**12}


@pytest.fixture(scope="module")
def line(spark):
    return catalog(spark, [("m a=1", i * 10**9, [1, 4, 9, 16, 25, 36][i]) for i in range(6)])


def values(cat, *steps, **more):
    return [r[2] for r in sorted(rows(build(cat, {"select": "m", "range": R, "apply": list(steps)} | more)), key=lambda r: r[1])]


def test_rate_sums_and_means(line):
    assert values(line, {"name": "rate"}) == [None, 3.0, 5.0, 7.0, 9.0, 11.0]
    assert values(line, {"name": "cusum"}) == values(line, {"name": "accumulate"}) == [1.0, 5.0, 14.0, 30.0, 55.0, 91.0]
    assert values(line, {"name": "cma"}) == [1.0, 2.5, 14 / 3, 7.5, 11.0, 91 / 6]
    assert values(line, {"name": "sma", "window-width": 2}) == [None, 1.0, 2.5, 6.5, 12.5, 20.5]
    assert values(line, {"name": "sma-error", "window-width": 2}) == [None, 3.0, 6.5, 9.5, 12.5, 15.5]


def test_backward_state_runs_backward(line):
    out = {r[1]: r[2] for r in rows(build(line, {"select": "m", "range": {"from": 10**12, "to": 0}, "apply": [{"name": "cusum"}]}))}
    assert out[5 * 10**9] == 36 and out[10**9] == 90


def test_steps_run_in_order(line):
    assert values(line, {"name": "cusum"}, {"name": "rate"}, {"name": "scale", "weights": [10]}) == [None, 40.0, 90.0, 160.0, 250.0, 360.0]


def test_ewma_warms_up_then_predicts(spark):
    x = [float(i * i % 17) for i in range(30)]
    cat = catalog(spark, [("m a=1", i * 10, v) for i, v in enumerate(x)])
    q = {"group-aggregate": {"step": 10, "metric": "m", "func": "mean"}, "range": {"from": 0, "to": 10**6}}
    got = [r[2] for r in sorted(rows(build(cat, q | {"apply": [{"name": "ewma", "decay": 0.2}]})), key=lambda r: r[1])]
    level, want = sum(x[:11]) / 11 * 0.8 + x[10] * 0.2, x[:11]
    for v in x[11:]:
        want.append(level)
        level = v * 0.2 + level * 0.8
    assert got == pytest.approx(want)
    with pytest.raises(QueryError):
        build(cat, {"select": "m", "range": R, "apply": [{"name": "ewma", "decay": 0.2}]})


def test_folds_of_tuples(spark):
    df = spark.createDataFrame([("s", 1, 6.0, 3.0), ("s", 2, 5.0, None), ("s", 3, 0.0, 2.0)], "series string, ts_ns bigint, c0 double, c1 double")
    f = Frame(df, ("c0", "c1"), {"a": "c0", "b": "c1"})

    def run(name, **p):
        return [r.value for r in FUNCTIONS[name](f, {"name": name} | p).rows.orderBy("ts_ns").collect()]

    assert run("sum", ignore_missing=True) == [9.0, 5.0, 2.0]
    assert run("diff", ignore_missing=True) == [-9.0, -5.0, -2.0]
    assert run("diff", ignore_missing=True, lhs_first=True) == [3.0, 5.0, -2.0]
    assert run("multiply", ignore_missing=True) == [18.0, 5.0, 0.0]
    assert run("divide", ignore_missing=True)[:2] == [1 / 18, 1 / 5] and run("divide", ignore_missing=True)[2] == math.inf
    assert math.isnan(run("sum", ignore_missing=False)[1])
    with pytest.raises(QueryError):
        run("sum")


def test_top_is_the_time_weighted_integral(spark):
    cat = catalog(spark, [("m a=1", 0, 1), ("m a=1", 10**10, 1), ("m a=2", 0, 5), ("m a=2", 10**10, 0), ("m a=3", 0, 100)])
    assert [(r[0], r[2]) for r in rows(build(cat, {"select": "m", "range": R, "apply": [{"name": "top", "N": 2}]}))] == [("m a=2", 50.0), ("m a=1", 10.0)]


def test_heavy_series(spark):
    cat = catalog(spark, [("m a=1", t, 1) for t in range(8)] + [("m a=2", t, 9) for t in range(2)])
    q = {"select": "m", "range": R}
    assert [(r[0], r[2]) for r in rows(build(cat, q | {"apply": [{"name": "frequent-items", "error": 0.1, "portion": 0.5}]}))] == [("m a=1", 8.0)]
    assert [(r[0], r[2]) for r in rows(build(cat, q | {"apply": [{"name": "heavy-hitters", "error": 0.1, "portion": 0.5}]}))] == [("m a=2", 18.0)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("1 + 2 + 3 + a + a.b", 15.0),
        ("-2 ^ 2", -4.0),
        ("2 ^ 3 ^ 2", 512.0),
        ("a / 0", math.inf),
        ("a > 3 && a.b < 3 ? 1 : 2", 2.0),
        ("min(a, a.b, 2) + max(1, 2) * avg(2, 4)", 8.0),
        ("sqrt(a) + abs(-1) + rint(2.6)", 6.0),
        ("a == 4 || 0", 1.0),
        ("ln(_e) + log10(100)", 3.0),
        ("1e1 + .5", 10.5),
    ],
)
def test_expressions(spark, text, want):
    col = compile_expression(text, {"a": F.lit(4.0), "a.b": F.lit(5.0)})
    assert spark.range(1).select(col.cast("double")).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("text", ["1, 2", "1 x 1", "b + 1", "", "(1", "sin(1, 2)", "1 +", "a..b", "__import__('os')"])
def test_bad_expressions(spark, text):
    with pytest.raises(QueryError):
        compile_expression(text, {"a": F.lit(1.0)})


def test_eval_takes_missing_as_zero_and_drops_nan(spark):
    cat = catalog(spark, [("a h=1", 1, 4), ("b h=1", 1, 2), ("b h=1", 2, 0)])
    assert rows(build(cat, {"join": ["a", "b"], "range": R, "apply": [{"name": "eval", "expr": "a / b"}]})) == [("a|b h=1", 1, 2.0)]


def test_sax_golden_words(spark):
    x = [0, 1, 2, 3, 0, 1, 2, 3, 0, 3, 0, 2, 1, 3]
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series string, ts_ns bigint, value double")
    want = "abcd bcda cdab dabc abcd bcda cdad dada adac dacb acbd".split()
    for cut in ({}, {"piece": 3}):
        assert [r.word for r in sax.words(df, 4, 4, **cut).orderBy("ts_ns").collect()] == want


def brute_along(data, backward):
    """Mean of the five values before, sum so far and number so far of each row."""
    out = set()
    for k in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == k), key=lambda r: r[1], reverse=backward)
        for i, (_, t, v) in enumerate(own):
            near, sofar = [x[2] for x in own[max(0, i - 5) : i] if x[2] is not None], [x[2] for x in own[: i + 1] if x[2] is not None]
            out.add((k, t, round(sum(near) / len(near), 9) if near else None, sum(sofar) if v is not None else None, len(sofar)))
    return out


@pytest.mark.parametrize("piece", [ordered.PIECE, 60, 7])
def test_pieces_give_what_whole_groups_give(spark, piece):
    """A hot series, stray times at both ends, series of a single row, nulls."""
    data = [("hot", t * 1000, float(t * t % 97)) for t in range(400)] + [("hot", 9_200_000_000_000_000_000, 1.0), ("hot", -9_200_000_000_000_000_000, 2.0)]
    data += [(f"s{k}", t, None if t % 5 == 0 else float(t)) for k in range(9) for t in range(k)]
    df = spark.createDataFrame(data, "series string, ts_ns bigint, value double").repartition(3)
    for backward in (False, True):
        once = ordered.numbered(df, "series", backward)
        means = ordered.along(once, "series", lambda d, w: d.withColumn("p", F.round(F.avg("value").over(w.rowsBetween(-5, -1)), 9)), 5, backward, piece)
        sums = ordered.running_sums(means.withColumn("v", F.col("value")), "series", ["v"], backward, piece)
        got = rows(sums.select("series", "ts_ns", "p", "v", "_seen_v"))
        assert len(got) == len(data) and set(got) == brute_along(data, backward)
    empty = df.limit(0)
    assert rows(ordered.running_sums(empty, "series", ["value"])) == []


def test_a_chain_computes_its_input_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("a", t, float(t)) for t in range(50)], "series string, ts_ns bigint, value double").mapInArrow(count, "series string, ts_ns bigint, value double")
    steps = [{"name": "cusum"}, {"name": "scale", "weights": [2]}, {"name": "rate"}, {"name": "sma", "window-width": 1}]
    out = run_steps(Frame(df, ("value",), {}), steps).rows
    assert sorted(rows(out))[2] == ("a", 2, 2e9) and out.columns == ["series", "ts_ns", "value"]
    assert seen.value == 50


def test_averages_are_linear_and_keep_their_state_over_batches(spark):
    n = 30_000
    df = spark.createDataFrame([("a", t, float(t % 3)) for t in range(n)] + [("b", t, None if t == 5 else 1.0) for t in range(40)], "series string, ts_ns bigint, value double")
    out = run_steps(Frame(df, ("value",), {}, False, True), [{"name": "ewma", "decay": 0.5}]).rows
    got = {(r.series, r.ts_ns): r.value for r in out.collect()}
    assert len(got) == n + 40 and got["b", 5] is None and got["b", 39] == 1.0
    level = sum(float(t % 3) for t in range(11)) / 11 * 0.5 + float(10 % 3) * 0.5
    for t in range(11, n):
        assert got["a", t] == pytest.approx(level)
        level = level * 0.5 + float(t % 3) * 0.5


def test_names(spark):
    cases = {
        " cpu  b=2   a=1 ": ("cpu a=1 b=2", "cpu"),
        "cpu a=x\\ y b=1": ("cpu a=x\\ y b=1", "cpu"),
        "m a.b=1 a=2": ("m a=2 a.b=1", "m"),
        "cpu": (None, None),
        "cpu region host=x": (None, None),
        "cpu region=x host": (None, None),
        "cpu a=1 a=2": (None, None),
        "": (None, None),
        "m a=" + "x" * 5000: (None, None),
        "m " + " ".join(f"t{i}=1" for i in range(33)): (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "n string")
    got = {r.n: (r.c, r.m) for r in df.select("n", names.canonical(F.col("n")).alias("c"), names.metric_of(F.col("n")).alias("m")).collect()}
    assert got == cases | {None: (None, None)}


def test_times_and_durations(spark):
    assert timefmt.parse_timestamp("20060102T150405.999999999") == 1136214245999999999
    assert timefmt.parse_timestamp("20060102T150405,5") == 1136214245500000000
    assert timefmt.format_timestamp(1136214245999999999) == "20060102T150405.999999999"
    for text, ns in (("10s", 10**10), ("111n", 111), ("111", 111), ("111us", 111000), ("111ms", 111 * 10**6), ("111m", 111 * 60 * 10**9), ("2min", 120 * 10**9), ("1d", 86400 * 10**9)):
        assert timefmt.parse_duration(text) == ns
    for bad in ("20060132T150405", "20061302T150405", "20060102T150405.", "yesterday", "-5", "", "20060102T1504"):
        with pytest.raises(QueryError):
            timefmt.parse_timestamp(bad)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 2**62), min_size=1, max_size=20))
def test_time_columns_agree_with_the_driver(spark, ns):
    df = spark.createDataFrame([(n,) for n in ns], "n bigint").select("n", timefmt.iso_column(F.col("n")).alias("t"))
    for r in df.select("n", "t", timefmt.parse_column(F.col("t")).alias("back")).collect():
        assert r.t == timefmt.format_timestamp(r.n) and r.back == r.n == timefmt.parse_timestamp(r.t)
