"""The line protocol: RESP frames of series, time and value, as bytes, files, or a stream of files.

A frame is a series name ``+name`` (several metrics: ``+m1|m2 tags``) or an id ``:n`` of the dictionary,
a time ``:ns`` or ``+iso``, and a value ``+3.14``, ``:3`` or, for several metrics, an array ``*n`` of
values. Event names start with ``!`` and take a text. A dictionary ``*2n`` of names and ids may come
first. A stream of frames is sequential, so a file is one split; large loads come as many files.

What can't be read ends the file's frames with one row that has ``error`` set, as everything after a
broken frame has no meaning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql.streaming import DataStreamReader

from tidewell.errors import QueryError
from tidewell.functions.timefmt import parse_timestamp
from tidewell.shipping import ship

ship(__name__)
ship("tidewell.functions.timefmt")
ship("tidewell.errors")

#: Suffix of complete files of frames.
SUFFIX = ".resp"
SCHEMA = "series string, ts_ns bigint, value double, body string, error string"
# Limits of the protocol in bytes and metrics.
MAX_STRING, MAX_BULK, MAX_EVENT, MAX_ROW = 1024, 1 << 20, 4096, 256


class BadFrame(ValueError):
    """A frame that breaks the protocol."""


@dataclass
class Token:
    kind: str
    value: object


def tokens(data: bytes) -> Iterator[Token]:
    """Tokens of a buffer: str, int, array, bulk, error. A cut-off last token is an error too."""
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise BadFrame("the last frame is cut off")
        line = data[at + 1 : end].removesuffix(b"\r")
        mark, at = data[at : at + 1], end + 1
        if mark == b"+":
            if len(line) > MAX_EVENT:
                raise BadFrame("text is too long")
            yield Token("str", line.decode("utf-8", "replace"))
        elif mark in (b":", b"*", b"$"):
            if not line.lstrip(b"-").isdigit():
                raise BadFrame(f"bad number {line[:20]!r}")
            n = int(line)
            if mark == b"$":
                if n < 0:
                    yield Token("bulk", None)
                    continue
                if n > MAX_BULK or at + n > len(data):
                    raise BadFrame("bulk text is too long or cut off")
                yield Token("bulk", data[at : at + n].decode("utf-8", "replace"))
                at += n
                at += 2 if data[at : at + 2] == b"\r\n" else 1
            else:
                yield Token("int" if mark == b":" else "array", n)
        elif mark == b"-":
            yield Token("error", line.decode("utf-8", "replace"))
        else:
            raise BadFrame(f"unknown frame type {mark!r}")


def expand_name(name: str) -> list[str]:
    """Names of a compound name: ``a|b tags`` is ``a tags`` and ``b tags``."""
    metric, space, tags = name.strip().partition(" ")
    return [f"{m}{space}{tags}" for m in metric.split("|")]


def _value(t: Token, event: bool) -> tuple[float | None, str | None]:
    if event:
        if t.kind not in ("str", "bulk") or t.value is None or len(str(t.value).encode()) >= MAX_EVENT:
            raise BadFrame("an event takes a text of less than 4096 bytes")
        return None, str(t.value)
    if t.kind == "int":
        return float(t.value), None
    if t.kind != "str":
        raise BadFrame("unexpected value format")
    try:
        return float(t.value), None
    except ValueError:
        raise BadFrame(f"can't parse value {t.value!r}") from None


Row = tuple[str | None, int | None, float | None, str | None, str | None]


def parse_frames(data: bytes, known: dict[int, list[str]] | None = None) -> Iterator[Row]:
    """Rows of a buffer in the order of ``SCHEMA``. With ``known``, names by id, the buffer goes on a stream whose dictionary was read."""
    first = known is None
    known = {} if known is None else known
    try:
        it = tokens(data)
        for t in it:
            if first and t.kind == "array":
                if t.value % 2:
                    raise BadFrame("a dictionary has pairs of name and id")
                for _ in range(t.value // 2):
                    name, key = next(it), next(it)
                    if name.kind not in ("str", "bulk") or key.kind != "int":
                        raise BadFrame("a dictionary has pairs of name and id")
                    known[key.value] = expand_name(str(name.value))
                first = False
                continue
            first = False
            if t.kind == "int":
                if t.value not in known:
                    raise BadFrame(f"id {t.value} isn't in the dictionary")
                names = known[t.value]
            elif t.kind == "str":
                names = expand_name(str(t.value))
            else:
                raise BadFrame("a series name or id was expected")
            if len(names) > MAX_ROW or any(len(n) > MAX_EVENT for n in names):
                raise BadFrame("too many metrics in a row, or too long a name")
            when = next(it)
            if when.kind not in ("int", "str"):
                raise BadFrame("a timestamp was expected")
            try:
                ts = parse_timestamp(when.value)
            except QueryError as e:
                raise BadFrame(str(e)) from None
            got = next(it)
            values = [got]
            if got.kind == "array":
                if got.value != len(names):
                    raise BadFrame(f"{len(names)} values were expected")
                values = [next(it) for _ in names]
            elif len(names) > 1:
                raise BadFrame("several metrics need an array of values")
            rows = [(n, ts, *_value(v, n.startswith("!")), None) for n, v in zip(names, values, strict=True)]
            yield from rows
    except StopIteration:
        yield None, None, None, None, "the last frame is cut off"
    except RuntimeError as e:
        yield None, None, None, None, str(e)
    except BadFrame as e:
        yield None, None, None, None, str(e)


def _of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            rows = parse_frames(memoryview(content.as_buffer()).tobytes())
            while part := list(islice(rows, 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)


def _files(reader: DataFrameReader | DataStreamReader, path: str, suffix: str = SUFFIX) -> DataFrame:
    files = reader.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", f"*{suffix}").load(path)
    return files.select("content").mapInArrow(_of_files, SCHEMA)


def read_frames(spark: SparkSession, path: str, suffix: str = SUFFIX) -> DataFrame:
    """Rows of the files of frames in a folder of any file system that Spark reads.

    A file is read as a whole by one task, as frames only make sense in order; listeners roll their files
    at 64 MB. Names that start with a dot or underscore, and other suffixes, are being written.
    """
    return _files(spark.read, path, suffix)


def stream_frames(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream: each file once, whatever its name and whenever it appears, as Spark notes the files it has seen."""
    return _files(spark.readStream.option("maxFilesPerTrigger", files_per_batch), path)
