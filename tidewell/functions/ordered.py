"""Computations along the rows of a group in order, for groups of any size.

Rows are written down once, sorted over the whole cluster by group, time and tie, and get ``POSITION``, their
number in that order. Pieces of ``PIECE`` positions, whatever groups they hold, carry some rows of the piece
before, and windows run per piece. Pieces are cut by counts: neither a group with a third of all rows nor
a stray time in the far past or future makes one larger. Further steps use the same positions.

Where the state isn't a window's, ``folded`` walks over sorted rows in Arrow batches and keeps one state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewell.operators.common import div
from tidewell.session import materialize
from tidewell.shipping import ship

ship(__name__)

#: Rows of a piece.
PIECE = 100_000
#: Column with a row's number in the order of groups and times, counted from 0 without gaps.
POSITION = "_position"
_BITS = 33  # of a row's number within a partition in Spark's generated ids


def _order(key: str, rows: DataFrame, backward: bool) -> list[Column]:
    cols = ["ts_ns"] + (["_tie"] if "_tie" in rows.columns else [])
    return [F.col(key).asc(), *(F.col(c).desc() if backward else F.col(c).asc() for c in cols)]


def numbered(rows: DataFrame, key: str, backward: bool = False) -> DataFrame:
    """Add ``POSITION`` to rows that lack it. The input is computed once; the sort samples what was written."""
    if POSITION in rows.columns:
        return rows
    rows = materialize(rows)
    order = _order(key, rows, backward)
    rows = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, within = F.shiftright("_id", _BITS), F.col("_id").bitwiseAND(F.lit((1 << _BITS) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg((F.max(within) + 1).alias("_n"))
    # one row per partition of the sort
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return rows.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(POSITION, F.col("_start") + within).drop("_part", "_start", "_id", "_tie")


def along(rows: DataFrame, key: str, compute: Callable[[DataFrame, WindowSpec], DataFrame], before: int, backward: bool = False, piece: int = PIECE) -> DataFrame:
    """``compute(rows, window)`` where the window orders a group and looks back at most ``before`` rows. ``compute`` keeps unknown columns."""
    size = max(piece, before, 1)
    rows = numbered(rows, key, backward).withColumn("_home", div(F.col(POSITION), size))
    later = F.when(F.col(POSITION) - F.col("_home") * size >= size - before, F.col("_home") + 1)
    rows = rows.withColumn("_piece", F.explode(F.array_compact(F.array(F.col("_home"), later))))
    out = compute(rows, Window.partitionBy("_piece", key).orderBy(POSITION))
    return out.filter("_piece = _home").drop("_piece", "_home")


def running_sums(rows: DataFrame, key: str, columns: Sequence[str], backward: bool = False, piece: int = PIECE) -> DataFrame:
    """Replace columns by their sums up to and including each row; nulls stay null and add nothing. Adds ``_seen_<column>``, the number of values so far."""
    rows = numbered(rows, key, backward).withColumn("_piece", div(F.col(POSITION), max(piece, 1)))
    totals = rows.groupBy("_piece", key).agg(*(f(c).alias(f"_{p}_{c}") for c in columns for p, f in (("s", F.sum), ("k", F.count))))
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_piece", key, *(F.coalesce(F.sum(f"_{p}_{c}").over(earlier), F.lit(0)).alias(f"_{p}_{c}") for c in columns for p in ("s", "k")))
    rows = rows.join(base, ["_piece", key])
    upto = Window.partitionBy("_piece", key).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    made = {}
    for c in columns:
        made[f"_seen_{c}"] = F.count(c).over(upto) + F.col(f"_k_{c}")
        # before the first value there is nothing to add to
        made[c] = F.when(F.col(c).isNotNull(), F.sum(c).over(upto) + F.col(f"_s_{c}"))
    drop = {"_piece", *(f"_{p}_{c}" for c in columns for p in ("s", "k"))}
    return rows.select(*(c for c in rows.columns if c not in columns and c not in drop), *(v.alias(c) for c, v in made.items()))


def folded(rows: DataFrame, key: str, columns: Sequence[str], start: Callable[[], Callable[[float | None], float | None]], backward: bool = False) -> DataFrame:
    """key, ts_ns and the columns, each value replaced by ``start()(value)`` of its group's own state, in the order of time.

    A group is walked through by one task in batches, with a state of bounded size: for rows of buckets,
    whose number per group is bounded by range and step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Any = None
        steps: list[Callable[[float | None], float | None]] = []
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), [[] for _ in columns]
            values = [batch.column(2 + i).to_pylist() for i in range(len(columns))]
            for k, row in zip(keys, zip(*values, strict=True), strict=True):
                if k != at or not steps:
                    at, steps = k, [start() for _ in columns]
                for o, f, v in zip(out, steps, row, strict=True):
                    o.append(f(v))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(o, pa.float64()) for o in out)], names=batch.schema.names)

    src = rows.select(key, "ts_ns", *(F.col(c).cast("double") for c in columns))
    src = src.repartition(key).sortWithinPartitions(key, F.col("ts_ns").desc() if backward else F.col("ts_ns").asc())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
    return src.mapInArrow(run, schema)
