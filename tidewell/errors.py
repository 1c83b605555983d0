"""Errors that a query can end with; each prints as one line that starts with '-'."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors that belong to a request and not to the engine."""

    def line(self) -> str:
        return "-" + " ".join(str(self).split())


class QueryError(EngineError):
    """The request is malformed or asks for something that isn't offered."""


class NotFound(EngineError):
    """A metric or series that the request names doesn't exist."""


class NoData(EngineError):
    """The grouping tags match no series."""
