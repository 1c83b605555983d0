"""Anomalies by forecasting: a series' value in a bucket against what its past foretells.

Per bucket the errors of all series form a vector; a series is an anomaly where the size of its error
exceeds ``threshold`` times the vector's length. Input is the output of a bucketed aggregation (series,
ts_ns, value), so a series has one row per bucket, a number bounded by range and step. Models: ``sma``,
``ewma``, ``double-exp``, ``holt-winters``; a bucket without a forecast is no anomaly.

With a ``sketch`` errors and lengths are estimated from count sketches, tables of (hashes, width) signed sums
per bucket of time; the median over the hashes stands for each. As every model is linear, that is the
same as forecasting from sketches of the values.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.errors import QueryError
from tidewell.functions.ordered import folded
from tidewell.shipping import ship

ship(__name__)

METHODS = ("sma", "ewma", "double-exp", "holt-winters")
#: Buckets that the exponential average takes in before it forecasts.
WARM = 10

#: Takes the value of a bucket and says what was foretold for it.
Model = Callable[[float], float | None]


def _sma(period: int) -> Model:
    past: deque[float] = deque(maxlen=period)

    def step(x: float) -> float | None:
        guess = sum(past) / period if len(past) == period else None
        past.append(x)
        return guess

    return step


def _ewma(alpha: float) -> Model:
    seen: list[float] = []
    level: float | None = None

    def step(x: float) -> float | None:
        nonlocal level
        guess = level
        if level is None:
            seen.append(x)
            if len(seen) == WARM:
                level = sum(seen) / WARM
        else:
            level += alpha * (x - level)
        return guess

    return step


def _trend(alpha: float, beta: float) -> Callable[[float | None], float | None]:
    """Level and slope of values; gives the next value foretold, null until there are two."""
    level: float | None = None
    slope: float | None = None

    def step(x: float) -> float | None:
        nonlocal level, slope
        if slope is None:
            level, slope = x, None if level is None else x - level
        else:
            before = level
            level = (1 - alpha) * (level + slope) + alpha * x
            slope += beta * (level - before - slope)
        return None if slope is None else level + slope

    return step


def _double(alpha: float, beta: float) -> Model:
    trend, ahead = _trend(alpha, beta), None

    def step(x: float) -> float | None:
        nonlocal ahead
        guess, ahead = ahead, trend(x)
        return guess

    return step


def _holt_winters(alpha: float, beta: float, gamma: float, period: int) -> Model:
    """Additive seasons: the first period gives the mean as level and the departures from it as seasonal parts."""
    first: list[float] = []
    season: deque[float] = deque(maxlen=period)
    level = slope = 0.0

    def step(x: float) -> float | None:
        nonlocal level, slope
        if len(first) < period:
            first.append(x)
            if len(first) == period:
                level = sum(first) / period
                season.extend(v - level for v in first)
            return None
        part = season[0]  # one period back
        guess = level + slope + part
        before = level
        level = alpha * (x - part) + (1 - alpha) * (level + slope)
        slope = beta * (level - before) + (1 - beta) * slope
        season.append(gamma * (x - level) + (1 - gamma) * part)
        return guess

    return step


def model(method: str, alpha: float, beta: float, gamma: float, period: int) -> Model:
    return {"sma": lambda: _sma(period), "ewma": lambda: _ewma(alpha), "double-exp": lambda: _double(alpha, beta), "holt-winters": lambda: _holt_winters(alpha, beta, gamma, period)}[method]()


def forecast(x: list[float], method: str, alpha: float = 0.0, beta: float = 0.0, gamma: float = 0.0, period: int = 0) -> list[float | None]:
    """What a model foretells for each value."""
    return list(map(model(method, alpha, beta, gamma, period), x))


def anomalies(buckets: DataFrame, method: str, threshold: float, alpha: float = 0.0, beta: float = 0.0, gamma: float = 0.0, period: int = 0, sketch: tuple[int, int] | None = None, backward: bool = False) -> DataFrame:
    """series, ts_ns, value, forecast, anomaly of each bucket with a value."""
    if method not in METHODS:
        raise QueryError(f"unknown method {method}")
    if any(not 0 <= c <= 1 for c in (alpha, beta, gamma)):
        raise QueryError("alpha, beta and gamma lie between 0 and 1")
    if method in ("sma", "holt-winters") and period < (1 if method == "sma" else 2):
        raise QueryError(f"{method} needs a period")
    if sketch is not None and (sketch[0] < 1 or sketch[1] < 1):
        raise QueryError("a sketch needs hashes and a width")
    src = buckets.select("series", "ts_ns", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    out = folded(src.withColumn("forecast", F.col("value")).select("series", "ts_ns", "value", "forecast"), "series", ["value", "forecast"], _Turns(method, alpha, beta, gamma, period), backward)
    out = out.withColumn("_e", F.col("value") - F.col("forecast"))
    if sketch is None:
        lengths = out.groupBy("ts_ns").agg(F.sqrt(F.sum(F.col("_e") * F.col("_e"))).alias("_length"))
        out = out.join(lengths, "ts_ns", "left").withColumn("_size", F.abs("_e"))
    else:
        out = _estimated(out, *sketch)
    return out.select("series", "ts_ns", "value", "forecast", F.coalesce(F.col("_size") > F.col("_length") * threshold, F.lit(False)).alias("anomaly"))


class _Turns:
    """States for the two columns of ``anomalies`` in turn: the value stays, the other becomes the forecast."""

    def __init__(self, *settings: object) -> None:
        self.settings, self.turn = settings, 0

    def __call__(self) -> Callable[[float], float | None]:
        self.turn += 1
        return (lambda x: x) if self.turn % 2 else model(*self.settings)


def _estimated(errors: DataFrame, hashes: int, width: int) -> DataFrame:
    """Add the median estimates of the size of each error and of the length of each bucket's vector."""
    each = errors.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1)))).withColumn("_x", F.xxhash64("_h", "series"))
    each = each.withColumn("_cell", F.pmod(F.shiftright("_x", 1), F.lit(width))).withColumn("_sign", F.when(F.col("_x") % 2 == 0, 1.0).otherwise(-1.0))
    cells = each.filter("_e is not null").groupBy("ts_ns", "_h", "_cell").agg(F.sum(F.col("_sign") * F.col("_e")).alias("_s"))
    lengths = cells.groupBy("ts_ns", "_h").agg(F.sum(F.col("_s") * F.col("_s")).alias("_q")).groupBy("ts_ns").agg(F.sqrt(F.median("_q")).alias("_length"))
    sizes = each.join(cells, ["ts_ns", "_h", "_cell"]).groupBy("series", "ts_ns").agg(F.abs(F.median(F.col("_sign") * F.col("_s"))).alias("_size"))
    return errors.join(sizes, ["series", "ts_ns"], "left").join(lengths, "ts_ns", "left")
