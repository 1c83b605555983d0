"""Fixtures of series as catalogs, and rows as plain tuples."""

from __future__ import annotations

from collections.abc import Iterable

from tidewell.plans.catalog import Catalog, dimension

SAMPLES = "series_id bigint, ts_ns bigint, value double"
EVENTS = "series_id bigint, ts_ns bigint, body string"


def catalog(spark, samples: Iterable[tuple[str, int, float]], events: Iterable[tuple[str, int, str]] = ()) -> Catalog:
    ids: dict[str, int] = {}
    rows = [(ids.setdefault(s, len(ids) + 1), t, None if v is None else float(v)) for s, t, v in samples]
    bodies = [(-ids.setdefault(s, len(ids) + 1), t, b) for s, t, b in events]
    names = [(-i if s.startswith("!") else i, s) for s, i in ids.items()]
    return Catalog(spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(bodies, EVENTS), dimension(spark.createDataFrame(names, "series_id bigint, series string")))


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def have_testdata() -> bool:
    import os

    return os.path.exists("/root/testdata/sf0.001/events.parquet")
