"""Implausible readings per source: impossible values, stuck values and spikes.

Three tests per reading, in time order within its source:

* ``impossible``: infinite, or outside the physical limits of its metric;
* ``stuck``: part of a run of at least ``STUCK_RUN`` equal readings, in a source where neighbours
  otherwise seldom agree (a run-length counter);
* ``spike``: part of an excursion of at most ``EXCURSION`` readings that two robust exponentially
  weighted control charts reject alike: one run forward sees the readings before, one run backward
  those after. A chart clips suspected values before they update its mean and scale; after more than
  ``EXCURSION`` suspects in a row it takes the new level as lasting. A lasting change of level is
  hence rejected by one chart only and is no spike.

A source may hold a third of all rows, so none is processed as a whole: readings are numbered within
their source by prefix sums over blocks and then cut into pieces of ``PIECE`` readings, each with
``HALO`` readings of its neighbours for the charts to settle. A piece counts the runs of its own readings
only; runs that reach over its ends are put together, and neighbours counted over the whole source, on a
table with one row per piece.

Defined cases: readings with null key or time, null or NaN value are absent; repeated rows count once;
null limits are no limits; two different values at the same time are ordered by value; a piece with
fewer than ``LEAST`` plausible readings gets no spikes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.common import DAY_NS, div, floor_to, present
from tidewell.session import materialize
from tidewell.shipping import ship

ship(__name__)

PIECE = 8192
HALO = 256
STUCK_RUN = 10
#: Share of equal neighbours from which equal readings are normal for a source. The run under judgement is left out; of every other
#: long run the first ``STUCK_RUN`` readings count, so that a source whose normal state is long runs isn't judged by the changes between them.
AGREE = 0.25
#: Marks of readings in runs: within a piece, at its start, at its end.
INSIDE, HEAD, TAIL = 1, 2, 3
#: Of a piece: readings, length of the first and of the last run, first and last value; of the runs between those two, the number of
#: long ones, the equal pairs in long ones, and the equal pairs in others.
COUNTS = "n bigint, head bigint, tail bigint, first double, last double, longs bigint, held bigint, same bigint"
EXCURSION = 3
LEAST = 20
#: Distance from the chart's mean, in scales, at which a reading is a spike, is suspected, and is clipped.
SPIKE, SUSPECT, CLIP = 5.5, 5.0, 3.0
#: Weights of a new reading in mean and scale; an absolute residual of normal noise times UNIT estimates its scale.
MEAN_WEIGHT, SCALE_WEIGHT, UNIT = 0.25, 0.05, 1.4


def control_chart(x: list[float], mean: float, scale: float, floor: float) -> list[float]:
    """Signed distance of each reading from the chart's mean before it, in units of the chart's scale.

    Suspects on one side in a row beyond ``EXCURSION`` are a new level: their distances become 0.
    """
    out = [0.0] * len(x)
    suspects = 0  # counted downwards on the lower side
    for i, v in enumerate(x):
        e = v - mean
        a = e if e >= 0 else -e
        out[i] = e / scale
        if a > SUSPECT * scale:
            suspects = (suspects + 1 if suspects > 0 else 1) if e > 0 else (suspects - 1 if suspects < 0 else -1)
            if suspects > EXCURSION or suspects < -EXCURSION:
                mean = sorted(x[i - EXCURSION : i + 1])[EXCURSION // 2]
                out[i - EXCURSION : i + 1] = [0.0] * (EXCURSION + 1)
                suspects = 0
            else:
                mean += MEAN_WEIGHT * scale if e > 0 else -MEAN_WEIGHT * scale
            continue
        suspects = 0
        if a > CLIP * scale:
            a = CLIP * scale
            e = a if e > 0 else -a
        mean += MEAN_WEIGHT * e
        scale += SCALE_WEIGHT * (UNIT * a - scale)
        if scale < floor:
            scale = floor
    return out


def run_lengths(same_as_next: np.ndarray) -> np.ndarray:
    """For each of n readings, the length of its run, from n - 1 flags of equality with the next."""
    starts = np.flatnonzero(np.concatenate(([True], ~same_as_next)))
    sizes = np.diff(np.append(starts, len(same_as_next) + 1))
    return np.repeat(sizes, sizes)


def runs(values: np.ndarray) -> tuple[np.ndarray, tuple[float, ...]]:
    """For the readings of one piece: which may be stuck, and what the rest of the source needs to know.

    The marks: ``INSIDE`` a long run within the piece; ``HEAD`` or ``TAIL``, the runs at the piece's ends,
    which may go on in its neighbours (only ``HEAD`` where one run fills the piece). The counts are those
    of ``COUNTS``.
    """
    lengths = run_lengths(values[1:] == values[:-1])
    n, head, tail = len(values), int(lengths[0]), int(lengths[-1])
    marks = np.where(lengths >= STUCK_RUN, INSIDE, 0).astype(np.int8)
    marks[n - tail :] = TAIL
    marks[:head] = HEAD
    inner = lengths[head : n - tail]
    held = inner >= STUCK_RUN
    # a run of m readings has m - 1 equal pairs: 1 - 1 / m for each of its readings
    pairs = 1 - 1 / inner
    counts = float(np.sum(1 / inner[held])), float(pairs[held].sum()), float(pairs[~held].sum())
    return marks, (n, head, tail, float(values[0]), float(values[-1]), *map(round, counts))


def spikes(values: np.ndarray) -> np.ndarray:
    """Flags of short excursions from the readings before and after, by a forward and a backward chart."""
    n = len(values)
    flags = np.zeros(n, bool)
    if n < LEAST:
        return flags
    steps = np.abs(np.diff(values))
    moved = steps[steps > 0]
    if not len(moved):
        return flags
    floor = max(float(np.minimum(steps, np.quantile(steps, 0.95)).mean()), float(np.median(moved))) * 0.5
    if not 0 < floor < np.inf:
        return flags
    x = values.tolist()
    ahead = np.asarray(control_chart(x, float(np.median(values[:15])), 2 * floor, floor))
    back = np.asarray(control_chart(x[::-1], float(np.median(values[-15:])), 2 * floor, floor))[::-1]
    off = (np.minimum(np.abs(ahead), np.abs(back)) > SPIKE) & (np.sign(ahead) == np.sign(back))
    if off.any():
        edges = off[1:] == off[:-1]
        flags = off & (run_lengths(edges) <= EXCURSION)
    return flags


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], int, int]]:
    """Columns and bounds of each (key, piece); rows of one arrive in a row, perhaps over several batches."""
    held: list[pa.RecordBatch] = []

    def columns(rows: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(rows)
        return {c: t[c].to_numpy() for c in t.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        key, piece = batch.column("key").to_numpy(), batch.column("piece").to_numpy()
        if held and (held[-1].column("key")[-1].as_py(), held[-1].column("piece")[-1].as_py()) != (key[0], piece[0]):
            c = columns(held)
            yield c, 0, len(c["key"])
            held = []
        starts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (piece[1:] != piece[:-1])) + 1).tolist()]
        if held and len(starts) > 1:
            c = columns([*held, batch.slice(0, starts[1])])
            yield c, 0, len(c["key"])
            held, starts = [], starts[1:]
        if held:
            held.append(batch)
            continue
        c = columns([batch])
        for a, b in zip(starts, starts[1:], strict=False):
            yield c, a, b
        held = [batch.slice(starts[-1])]
    if held:
        c = columns(held)
        yield c, 0, len(c["key"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Readings that fail a test or may be stuck, and for each piece a row without time that holds its counts."""
    names = ["key", "piece", "ts", "value", "impossible", "spike", "run"]
    kinds = [pa.int64()] * 3 + [pa.float64()] * 2 + [pa.int64()] * 3
    counted = [c.split()[0] for c in COUNTS.split(", ")]
    found: list[tuple[np.ndarray, ...]] = []
    pieces: list[tuple[int, int, tuple[float, ...]]] = []
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        if found:
            columns = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(columns[0]), t) for t in kinds)], names=[*names, *counted])
        if pieces:
            key, piece, counts = zip(*pieces, strict=True)
            none = [pa.nulls(len(key), t) for t in (pa.int64(), pa.float64(), pa.bool_(), pa.bool_(), pa.int8())]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(piece, pa.int64()), *none, *(pa.array(x, t) for x, t in zip(zip(*counts, strict=True), kinds, strict=True))], names=[*names, *counted])

    for c, a, b in _pieces(batches):
        own = c["own"][a:b].astype(bool)
        if not own.any():
            continue
        value, bad = c["value"][a:b], c["impossible"][a:b].astype(bool)
        run = np.zeros(b - a, np.int8)
        run[own], counts = runs(value[own])
        pieces.append((int(c["key"][a]), int(c["piece"][a]), counts))
        off = np.zeros(b - a, bool)
        off[~bad] = spikes(value[~bad])
        pick = np.flatnonzero(own & (bad | (run > 0) | off))
        found.append((c["key"][a:b][pick], c["piece"][a:b][pick], c["ts"][a:b][pick], value[pick], bad[pick], off[pick], run[pick]))
        size += len(pick)
        if size >= 10_000:
            yield from rows()
            found, pieces, size = [], [], 0
    yield from rows()


def stuck_runs(pieces: DataFrame) -> DataFrame:
    """key, piece, long_head, long_tail of the pieces of sources whose neighbours otherwise seldom agree.

    ``pieces`` has one row per piece with its ``COUNTS``. No window holds more than the two end runs of
    each piece of a source.
    """
    ends = F.array(F.struct(F.lit(HEAD).alias("end"), F.col("head").alias("size")), F.when(F.col("head") < F.col("n"), F.struct(F.lit(TAIL).alias("end"), F.col("tail").alias("size"))))
    in_order = Window.partitionBy("key").orderBy("piece")
    goes_on = F.coalesce(F.col("first") == F.lag("last").over(in_order), F.lit(False))
    e = pieces.withColumn("goes_on", goes_on).withColumn("e", F.explode(F.array_compact(ends))).select("key", "piece", "goes_on", "e.*", *(F.when(F.col("e.end") == HEAD, F.col(c)).otherwise(0).alias(c) for c in ("n", "longs", "held", "same")))
    begins = F.when((F.col("end") == HEAD) & F.col("goes_on"), 0).otherwise(1)
    e = e.withColumn("begins", begins).withColumn("run", F.sum("begins").over(Window.partitionBy("key").orderBy("piece", "end").rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("size", F.sum("size").over(Window.partitionBy("key", "run")))
    long, once = F.col("size") >= STUCK_RUN, F.col("begins") == 1
    pairs = F.col("size") - 1
    total = e.groupBy("key").agg(
        (F.sum("n") - 1).alias("pairs"),
        (F.sum("held") + F.sum(F.when(once & long, pairs).otherwise(0))).alias("held"),
        (F.sum("same") + F.sum(F.when(once & ~long, pairs).otherwise(0))).alias("same"),
        (F.sum("longs") + F.sum((once & long).cast("bigint"))).alias("longs"),
    )
    others, capped = F.col("pairs") - F.col("held"), (F.col("longs") - 1) * (STUCK_RUN - 1)
    seldom = total.filter((others >= LEAST // 2) & (F.col("same") + capped < AGREE * (others + capped))).select("key")
    at = lambda end: F.max(F.when(F.col("end") == end, long).otherwise(False))
    return e.groupBy("key", "piece").agg(at(HEAD).alias("long_head"), at(TAIL).alias("long_tail")).join(seldom, "key", "left_semi")


def numbered(readings: DataFrame) -> DataFrame:
    """Distinct readings with ``at``, their number within their source, and ``impossible``.

    ``readings`` needs series_id, ts_ns, value, step_ns (null: unknown), lo and hi. Counts per block of
    time are summed over blocks, and over blocks of blocks, so that no window holds a source's rows.
    """
    block_ns = F.coalesce(F.when(F.col("step_ns") > 0, F.col("step_ns") * 512), F.lit(DAY_NS))
    bad = F.col("value").isin(float("inf"), float("-inf")) | F.coalesce(F.col("value") < F.col("lo"), F.lit(False)) | F.coalesce(F.col("value") > F.col("hi"), F.lit(False))
    src = readings.filter(F.col("series_id").isNotNull() & F.col("ts_ns").isNotNull() & present("value"))
    src = src.select(F.col("series_id").alias("key"), F.col("ts_ns").alias("ts"), "value", bad.alias("impossible"), floor_to(F.col("ts_ns"), block_ns).alias("block"))
    distinct = src.repartition("key", "block").dropDuplicates(["key", "block", "ts", "value", "impossible"])
    rows = distinct.withColumn("n", F.row_number().over(Window.partitionBy("key", "block").orderBy("ts", "value")))
    # counted before the numbering, which need not be sorted for it
    counts = distinct.groupBy("key", "block").agg(F.count("*").alias("rows")).withColumn("wide", floor_to(F.col("block"), 1024))
    earlier = Window.unboundedPreceding, -1
    near = counts.withColumn("near", F.coalesce(F.sum("rows").over(Window.partitionBy("key", "wide").orderBy("block").rowsBetween(*earlier)), F.lit(0)))
    far = counts.groupBy("key", "wide").agg(F.sum("rows").alias("rows")).withColumn("far", F.coalesce(F.sum("rows").over(Window.partitionBy("key").orderBy("wide").rowsBetween(*earlier)), F.lit(0)))
    starts = near.join(far.select("key", "wide", "far"), ["key", "wide"]).select("key", "block", (F.col("near") + F.col("far")).alias("start"))
    return rows.join(starts, ["key", "block"]).select("key", "ts", "value", "impossible", (F.col("start") + F.col("n") - 1).alias("at"))


def implausible(readings: DataFrame, piece: int = PIECE, halo: int = HALO) -> DataFrame:
    """key, ts, value, impossible, stuck, spike of each reading that fails a test."""
    if halo < STUCK_RUN or piece < halo:
        raise ValueError("a halo must cover a stuck run and fit into a piece")
    rows = numbered(readings).withColumn("home", div(F.col("at"), piece))
    inside = F.col("at") - F.col("home") * piece
    to = F.array_compact(F.array(F.col("home"), F.when((inside < halo) & (F.col("home") > 0), F.col("home") - 1), F.when(inside >= piece - halo, F.col("home") + 1)))
    rows = rows.withColumn("piece", F.explode(to)).select("key", "piece", "at", "ts", "value", "impossible", (F.col("piece") == F.col("home")).alias("own"))
    rows = rows.repartition("key", "piece").sortWithinPartitions("key", "piece", "at").drop("at")
    judged = materialize(rows.mapInArrow(_judge, f"key bigint, piece bigint, ts bigint, value double, impossible boolean, spike boolean, run tinyint, {COUNTS}"))
    ends = stuck_runs(judged.filter("n is not null").select("key", "piece", *(c.split()[0] for c in COUNTS.split(", "))))
    found = judged.filter("n is null").join(ends, ["key", "piece"], "left")
    held = ((F.col("run") == INSIDE) & F.col("long_head").isNotNull()) | ((F.col("run") == HEAD) & F.col("long_head")) | ((F.col("run") == TAIL) & F.col("long_tail"))
    found = found.withColumn("stuck", F.coalesce(held, F.lit(False)))
    return found.filter("impossible or stuck or spike").select("key", "ts", "value", "impossible", "stuck", "spike")
