"""The façade: queries, suggestions and searches as JSON in, DataFrames, cursors or text lines out."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

import tidewell
from tidewell.errors import EngineError
from tidewell.functions.apply import FUNCTIONS
from tidewell.plans.build import build, in_default_order, search, suggest
from tidewell.plans.catalog import Catalog
from tidewell.plans.spec import load, parse, parse_search, parse_suggest
from tidewell.session import prepare
from tidewell.sinks.text import lines


class Cursor:
    """Rows of a result, pulled partition by partition; an error of the request is kept and not raised."""

    def __init__(self, make) -> None:
        self.error: str | None = None
        self._rows: Iterator[Row] = iter(())
        self._next: Row | None = None
        try:
            self._rows = make().toLocalIterator()
            self._next = next(self._rows, None)
        except EngineError as e:
            self.error = e.line()

    @property
    def is_done(self) -> bool:
        return self._next is None

    @property
    def is_error(self) -> bool:
        return self.error is not None

    def read(self, n: int) -> list[Row]:
        """Up to n further rows."""
        out: list[Row] = []
        while len(out) < n and self._next is not None:
            out.append(self._next)
            self._next = next(self._rows, None)
        return out


class Engine:
    """Queries over a catalog."""

    def __init__(self, spark: SparkSession, catalog: Catalog) -> None:
        self.spark, self.catalog = prepare(spark), catalog

    def query(self, request: str | Mapping[str, Any]) -> DataFrame:
        return build(self.catalog, request)

    def suggest(self, request: str | Mapping[str, Any]) -> DataFrame:
        return suggest(self.catalog, request)

    def search(self, request: str | Mapping[str, Any]) -> DataFrame:
        return search(self.catalog, request)

    def cursor(self, request: str | Mapping[str, Any]) -> Cursor:
        return Cursor(lambda: self.query(in_default_order(parse(request))))

    def respond(self, path: str, request: str | Mapping[str, Any] = "{}") -> tuple[int, Iterator[str]]:
        """Status and lines of a request to /api/query, /api/suggest, /api/search, /api/stats, /api/function-names or /api/version."""
        try:
            if path == "/api/query":
                q = in_default_order(parse(request))
                out = self.query(q)
                form, iso = q.format, q.iso
            elif path in ("/api/suggest", "/api/search"):
                q = (parse_suggest if path.endswith("suggest") else parse_search)(load(request))
                out = (self.suggest if path.endswith("suggest") else self.search)(load(request))
                out = out.toDF("series")
                form, iso = q.format, q.iso
            elif path == "/api/function-names":
                return 200, iter(function_names())
            elif path == "/api/version":
                return 200, iter([tidewell.__version__])
            elif path == "/api/stats":
                return 200, (f"{k}={v}" for k, v in self.stats().items())
            else:
                return 404, iter(["-not found"])
            return 200, (r.line for r in lines(out, form, iso).toLocalIterator())
        except EngineError as e:
            return 400, iter([e.line()])

    def stats(self) -> dict[str, int]:
        """Series, metrics, samples and events of the catalog."""
        return {
            "series": self.catalog.series.count(),
            "metrics": self.catalog.series.select("metric").distinct().count(),
            "samples": self.catalog.samples.count(),
            "events": self.catalog.events.count(),
        }


def function_names() -> list[str]:
    return sorted(FUNCTIONS)
