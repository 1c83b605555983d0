"""Functions of the ``apply`` clause, each a transformation of a result.

A result has series, ts_ns and value columns. State runs per series and column in the order of the query:
descending times for a backward query. Steps run in the order given.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidewell.errors import QueryError
from tidewell.functions import sax
from tidewell.functions.expr import compile_expression
from tidewell.functions.ordered import POSITION, along, folded, running_sums
from tidewell.operators.anomaly import anomalies
from tidewell.shipping import ship

ship(__name__)

#: Readings that an exponential average takes in before it predicts.
EWMA_WARM = 11


@dataclass(frozen=True)
class Frame:
    """A result on its way through the functions."""

    rows: DataFrame
    columns: tuple[str, ...]
    names: Mapping[str, str]
    backward: bool = False
    regular: bool = False

    def of(self, rows: DataFrame, columns: Sequence[str] | None = None) -> Frame:
        cols = tuple(columns) if columns is not None else self.columns
        names = self.names if cols == self.columns else {c: c for c in cols}
        return Frame(rows, cols, names, self.backward, self.regular)


def _number(p: Mapping[str, Any], key: str, default: float | None = None) -> float:
    if key not in p and default is None:
        raise QueryError(f"{p['name']} needs {key}")
    try:
        return float(p.get(key, default))
    except (TypeError, ValueError):
        raise QueryError(f"{p['name']}: {key} is no number") from None


def _flag(p: Mapping[str, Any], key: str) -> bool:
    if key not in p:
        raise QueryError(f"{p['name']} needs {key}")
    if str(p[key]).lower() not in ("true", "false", "1", "0"):
        raise QueryError(f"{p['name']}: {key} must be true or false")
    return str(p[key]).lower() in ("true", "1")


def _scalar(f: Frame, p: Mapping[str, Any]) -> str:
    if len(f.columns) != 1:
        raise QueryError(f"{p['name']} works on single values only")
    return f.columns[0]


def _regular(f: Frame, p: Mapping[str, Any]) -> None:
    if not f.regular:
        raise QueryError(f"{p['name']} needs regular data; use it with group-aggregate")


def _position(f: Frame) -> list[str]:
    """The column of positions, where rows have it: steps that keep all rows keep it for the next one."""
    return [c for c in (POSITION,) if c in f.rows.columns]


def _rate(f: Frame, p: Mapping[str, Any]) -> Frame:
    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        dt = F.col("ts_ns") - F.lag("ts_ns").over(w)
        return df.select(*(c for c in df.columns if c not in f.columns), *(F.when(dt != 0, (F.col(c) - F.lag(c).over(w)) / F.when(dt != 0, dt) * 1e9).alias(c) for c in f.columns))

    return f.of(along(f.rows, "series", compute, 1, f.backward))


def _cusum(f: Frame, p: Mapping[str, Any]) -> Frame:
    out = running_sums(f.rows, "series", list(f.columns), f.backward)
    return f.of(out.select("series", "ts_ns", POSITION, *f.columns))


def _cma(f: Frame, p: Mapping[str, Any]) -> Frame:
    out = running_sums(f.rows, "series", list(f.columns), f.backward)
    return f.of(out.select("series", "ts_ns", POSITION, *((F.col(c) / F.when(F.col(f"_seen_{c}") > 0, F.col(f"_seen_{c}"))).alias(c) for c in f.columns)))


def _sma(error: bool) -> Callable[[Frame, Mapping[str, Any]], Frame]:
    def run(f: Frame, p: Mapping[str, Any]) -> Frame:
        n = int(_number(p, "window-width"))
        if n < 1:
            raise QueryError("window-width must be positive")

        def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
            mean = {c: F.avg(c).over(w.rowsBetween(-n, -1)) for c in f.columns}
            return df.select(*(c for c in df.columns if c not in f.columns), *((F.col(c) - mean[c] if error else mean[c]).alias(c) for c in f.columns))

        return f.of(along(f.rows, "series", compute, n, f.backward))

    return run


def _smoothed(decay: float, error: bool) -> Callable[[float | None], float | None]:
    """One step of an exponential average; null for null. While it warms up a value foretells itself."""
    n, level = 0, 0.0

    def step(x: float | None) -> float | None:
        nonlocal n, level
        if x is None:
            return None
        guess = x if n < EWMA_WARM else level
        n += 1
        if n < EWMA_WARM:
            level += x
        else:
            if n == EWMA_WARM:
                level = (level + x) / EWMA_WARM
            level = level * (1 - decay) + x * decay
        return x - guess if error else guess

    return step


def _ewma(error: bool) -> Callable[[Frame, Mapping[str, Any]], Frame]:
    """One walk over the buckets of a series, whose number is bounded by range and step."""

    def run(f: Frame, p: Mapping[str, Any]) -> Frame:
        _regular(f, p)
        decay = _number(p, "decay")
        return f.of(folded(f.rows, "series", f.columns, lambda: _smoothed(decay, error), f.backward))

    return run


def _anomalies(f: Frame, p: Mapping[str, Any]) -> Frame:
    """The buckets whose value is an anomaly."""
    _regular(f, p)
    c = _scalar(f, p)
    method = str(p.get("method", ""))
    sketch = (int(_number(p, "hashes", 3)), 1 << int(_number(p, "bits", 10))) if method.endswith("-sketch") else None
    out = anomalies(f.rows.select("series", "ts_ns", F.col(c).alias("value")), method.removesuffix("-sketch"), _number(p, "threshold"), _number(p, "alpha", 0), _number(p, "beta", 0), _number(p, "gamma", 0), int(_number(p, "period", 0)), sketch, f.backward)
    return f.of(out.filter("anomaly").select("series", "ts_ns", "value"), ["value"])


def _fold(unit: float, combine: Callable[[Column, Column], Column], start: float | None = None) -> Callable[[Frame, Mapping[str, Any]], Frame]:
    """Fold the elements of a tuple; missing ones count as the unit, or make the result NaN."""

    def run(f: Frame, p: Mapping[str, Any]) -> Frame:
        ignore = _flag(p, "ignore_missing")
        lhs = start is not None and str(p.get("lhs_first", "false")).lower() == "true"
        cols = [F.coalesce(F.col(c), F.lit(unit if ignore else float("nan"))) for c in f.columns]
        first = cols[0] if lhs else (combine(F.lit(start), cols[0]) if start is not None else cols[0])
        return f.of(f.rows.select("series", "ts_ns", *_position(f), reduce(combine, cols[1:], first).alias("value")), ["value"])

    return run


def _quotient(a: Column, b: Column) -> Column:
    from tidewell.functions.expr import divided

    return divided(a, b)


def _scale(f: Frame, p: Mapping[str, Any]) -> Frame:
    w = p.get("weights")
    if not isinstance(w, list) or not w:
        raise QueryError("scale needs weights")
    by = [_number({"name": "scale", "w": x}, "w") for x in w]
    return f.of(f.rows.select("series", "ts_ns", *_position(f), *((F.col(c) * by[i] if i < len(by) else F.col(c)).alias(c) for i, c in enumerate(f.columns))))


def _abs(f: Frame, p: Mapping[str, Any]) -> Frame:
    return f.of(f.rows.select("series", "ts_ns", *_position(f), *(F.abs(c).alias(c) for c in f.columns)))


def _eval(f: Frame, p: Mapping[str, Any]) -> Frame:
    if not isinstance(p.get("expr"), str):
        raise QueryError("eval needs expr")
    known = {name: F.coalesce(F.col(c), F.lit(0.0)) for name, c in f.names.items()}
    value = compile_expression(p["expr"], known).cast("double")
    out = f.rows.select("series", "ts_ns", value.alias("value")).filter(~F.isnan("value") & F.col("value").isNotNull())
    return f.of(out, ["value"])


def _top(f: Frame, p: Mapping[str, Any]) -> Frame:
    c, n = _scalar(f, p), int(_number(p, "N"))
    if n < 1:
        raise QueryError("top: N must be positive")

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        part = F.lag(c).over(w) * ((F.col("ts_ns") - F.lag("ts_ns").over(w)) / F.lit(1e9))
        return df.withColumn("_part", F.coalesce(part, F.lit(0.0)))

    parts = along(f.rows.filter(F.col(c).isNotNull()).drop(POSITION), "series", compute, 1, f.backward)
    sums = parts.groupBy("series").agg(F.max("ts_ns").alias("ts_ns"), F.sum("_part").alias("value"))
    return f.of(sums.orderBy(F.col("value").desc(), "series").limit(n), ["value"])


def _heavy(weighted: bool) -> Callable[[Frame, Mapping[str, Any]], Frame]:
    """Series whose count, or sum of values, exceeds a portion of the total; counted exactly."""

    def run(f: Frame, p: Mapping[str, Any]) -> Frame:
        c, error, portion = _scalar(f, p), _number(p, "error"), _number(p, "portion")
        if error == 0:
            raise QueryError(f"{p['name']}: error must differ from 0")
        if not 0 <= portion <= 1:
            raise QueryError(f"{p['name']}: portion lies outside 0 to 1")
        rows = f.rows.filter(F.col(c).isNotNull())
        weight = F.sum(c) if weighted else F.count("*").cast("double")
        counts = rows.groupBy("series").agg(weight.alias("value"), F.min("ts_ns").alias("ts_ns") if not f.backward else F.max("ts_ns").alias("ts_ns"))
        # one row with the total
        total = counts.agg(F.sum("value").alias("_total"))
        kept = counts.join(F.broadcast(total)).filter(F.col("value") > F.col("_total") * portion)
        return f.of(kept.select("series", "ts_ns", "value"), ["value"])

    return run


def _sax(f: Frame, p: Mapping[str, Any]) -> Frame:
    c = _scalar(f, p)
    rows = f.rows.select("series", "ts_ns", F.col(c).alias("value"))
    return f.of(sax.words(rows, int(_number(p, "alphabet_size")), int(_number(p, "window_width")), backward=f.backward), ["word"])


FUNCTIONS: dict[str, Callable[[Frame, Mapping[str, Any]], Frame]] = {
    "rate": _rate,
    "accumulate": _cusum,
    "cusum": _cusum,
    "cma": _cma,
    "sma": _sma(False),
    "sma-error": _sma(True),
    "ewma": _ewma(False),
    "ewma-error": _ewma(True),
    "sum": _fold(0.0, lambda a, b: a + b),
    "diff": _fold(0.0, lambda a, b: a - b, 0.0),
    "multiply": _fold(1.0, lambda a, b: a * b),
    "divide": _fold(1.0, _quotient, 1.0),
    "scale": _scale,
    "abs": _abs,
    "eval": _eval,
    "top": _top,
    "frequent-items": _heavy(False),
    "heavy-hitters": _heavy(True),
    "sax": _sax,
    "anomaly-detector": _anomalies,
}


def run_steps(f: Frame, steps: Sequence[Mapping[str, Any]]) -> Frame:
    for p in steps:
        if p["name"] not in FUNCTIONS:
            raise QueryError(f"unknown function {p['name']}")
        f = FUNCTIONS[p["name"]](f, p)
    return Frame(f.rows.drop(POSITION), f.columns, f.names, f.backward, f.regular)
