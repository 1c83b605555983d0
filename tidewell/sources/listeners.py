"""Network endpoints that land what they receive as files, for ``stream_frames`` and ``spark.readStream.text``.

Spark replays a batch after a failure, which a socket can't; a folder of complete files can. A listener
is one process beside the cluster, and any number may write to one folder, on any file system that
pyarrow knows by its address. Each file is written under a hidden name with another suffix and then renamed,
so a reader sees whole files only.

Writers are answered as far as a listener can judge: broken input, and rows that aren't later than what
it took of the same series before. It remembers at most ``SERIES`` series; what it can't judge is judged
when the files are loaded.
"""

from __future__ import annotations

import os
import re
import socket
import socketserver
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyarrow import fs

from tidewell.errors import QueryError
from tidewell.functions.timefmt import parse_timestamp
from tidewell.sources.lines import IGNORED, REPLIES, SECONDS_BELOW
from tidewell.sources.resp import SUFFIX, expand_name, parse_frames

#: Series whose last time a listener remembers.
SERIES = 1_000_000
#: Suffix of files of put lines.
LINES = ".put"
# How replies begin that clients look for.
LATE, BROKEN = "-DB late write", "-PARSER "
_WORDS = re.compile(r"(?<!\\) +")


class Landing:
    """Writes buffers as files whose names sort by time."""

    def __init__(self, folder: str, suffix: str = SUFFIX) -> None:
        self.fs, self.folder = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        self.suffix = suffix
        self.fs.create_dir(self.folder)

    def write(self, data: bytes) -> str:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        hidden, final = f"{self.folder}/.{name}.part", f"{self.folder}/{name}{self.suffix}"
        with self.fs.open_output_stream(hidden) as f:
            f.write(data)
        self.fs.move(hidden, final)
        return final


class Roll:
    """Gathers pieces of one source and lands them when they are large or old enough; each file begins with ``head``."""

    def __init__(self, landing: Landing, size: int, every: float) -> None:
        self.landing, self.size, self.every, self.head = landing, size, every, b""
        self.held: list[bytes] = []
        self.n, self.since, self.lock = 0, time.monotonic(), threading.Lock()

    def add(self, data: bytes) -> None:
        with self.lock:
            if not self.held:
                self.since = time.monotonic()
            self.held.append(data)
            self.n += len(data)
            if self.n >= self.size:
                self._land()

    def tick(self) -> None:
        with self.lock:
            if self.held and time.monotonic() - self.since >= self.every:
                self._land()

    def flush(self) -> None:
        with self.lock:
            self._land()

    def _land(self) -> None:
        if self.held:
            self.landing.write(self.head + b"".join(self.held))
            self.held, self.n = [], 0


class LastTimes:
    """The last time taken of each series, of the ``SERIES`` written last."""

    def __init__(self, most: int = SERIES) -> None:
        self.most, self.last, self.lock = most, OrderedDict(), threading.Lock()

    def take(self, series: str, ts: int) -> bool:
        """Whether a row is later than those before; if so it is noted."""
        with self.lock:
            ok = ts > self.last.get(series, ts - 1)
            if ok:
                self.last[series] = ts
            if series in self.last:
                self.last.move_to_end(series)
            if len(self.last) > self.most:
                self.last.popitem(last=False)
            return ok


def usual_name(name: str) -> str | None:
    """A name with its tags in order, None for one that can't be a series."""
    words = [w for w in _WORDS.split(name.strip()) if w]
    good = len(words) > 1 and all("=" in w and w[0] != "=" and w[-1:] != "=" for w in words[1:])
    return " ".join([words[0], *sorted(words[1:])]) if good else None


class _Server:
    """A server with one thread per connection and one that lands what has become old."""

    def __init__(self, landing: Landing, address: tuple[str, int], roll: int, every: float, talk: Callable) -> None:
        self.rolls: set[Roll] = set()
        self.every, self.running = every, True

        class Handler(socketserver.StreamRequestHandler):
            def handle(inner) -> None:  # noqa: N805 - self is the server
                mine = Roll(landing, roll, every)
                self.rolls.add(mine)
                try:
                    talk(inner.rfile, inner.wfile, mine)
                except (ConnectionError, ValueError):
                    pass
                finally:
                    mine.flush()
                    self.rolls.discard(mine)

        socketserver.ThreadingTCPServer.allow_reuse_address = True
        self.server = socketserver.ThreadingTCPServer(address, Handler)
        self.server.daemon_threads = True
        self.address = self.server.server_address
        for f in (self.server.serve_forever, self._age):
            threading.Thread(target=f, daemon=True).start()

    def _age(self) -> None:
        while self.running:
            time.sleep(self.every / 4)
            for r in list(self.rolls):
                r.tick()

    def close(self) -> None:
        self.running = False
        self.server.shutdown()
        self.server.server_close()
        for r in list(self.rolls):
            r.flush()


class TcpListener(_Server):
    """Frames of each connection in files of about ``roll`` bytes or ``every`` seconds, cut between frames; each file repeats the dictionary.

    A broken frame is answered and ends the connection, as nothing after it has a meaning. A late row is
    answered and left out.
    """

    def __init__(self, folder: str, host: str = "127.0.0.1", port: int = 0, roll: int = 64 << 20, every: float = 5.0) -> None:
        self.times = LastTimes()
        super().__init__(Landing(folder), (host, port), roll, every, self._talk)

    @staticmethod
    def _token(rfile) -> bytes:
        line = rfile.readline(1 << 21)
        if line[:1] == b"$" and line[1:].strip().isdigit():
            line += rfile.read(int(line[1:]) + 2)
        return line

    def _items(self, rfile, head: bytes) -> bytes:
        """The elements that follow an array's head."""
        n = head[1:].strip()
        return b"".join(self._token(rfile) for _ in range(min(int(n), 1 << 20))) if head[:1] == b"*" and n.isdigit() else b""

    def _talk(self, rfile, wfile, out: Roll) -> None:
        known: dict[int, list[str]] = {}
        first = True
        while name := self._token(rfile):
            if first and name[:1] == b"*":
                out.head = name + self._items(rfile, name)
                first = False
                # a dictionary alone has no rows, but may be broken
                if bad := [r[4] for r in parse_frames(out.head) if r[4]]:
                    wfile.write(f"{BROKEN}{bad[0]}\r\n".encode())
                    return
                parts = out.head.split(b"\r\n")[1:-1]
                known = {int(k[1:]): expand_name(n[1:].decode("utf-8", "replace")) for n, k in zip(parts[::2], parts[1::2], strict=False) if n[:1] == b"+"}
                continue
            first = False
            frame = name
            if name[:1] in (b"+", b":"):
                frame += self._token(rfile) + (value := self._token(rfile)) + self._items(rfile, value)
            rows = list(parse_frames(frame, known))
            series = [usual_name(r[0]) for r in rows if not r[4]]
            if bad := next((r[4] for r in rows if r[4]), "bad series name" if None in series or not series else None):
                wfile.write(f"{BROKEN}{bad}\r\n".encode())
                return
            taken = [self.times.take(n, r[1]) for n, r in zip(series, rows, strict=True)]
            if any(taken):
                # late rows among them are refused again when the file is loaded
                out.add(frame)
            if not all(taken):
                wfile.write(f"{LATE}\r\n".encode())


class PutListener(_Server):
    """Put lines of each connection, landed as they are if they can be read; other verbs and errors are answered."""

    def __init__(self, folder: str, host: str = "127.0.0.1", port: int = 0, roll: int = 64 << 20, every: float = 5.0) -> None:
        self.times = LastTimes()
        super().__init__(Landing(folder, LINES), (host, port), roll, every, self._talk)

    def _talk(self, rfile, wfile, out: Roll) -> None:
        while line := rfile.readline(1 << 16):
            reply = self._reply(line.decode("utf-8", "replace").strip())
            if reply is None:
                out.add(line.rstrip(b"\r\n") + b"\n")
            elif reply:
                wfile.write(reply.encode())

    def _reply(self, text: str) -> str | None:
        """None for a line to land, else the answer, which may be empty."""
        words = [w for w in _WORDS.split(text) if w]
        if not words or (words[0] in IGNORED and words[0] not in REPLIES):
            return ""
        if words[0] in REPLIES:
            return REPLIES[words[0]]
        if words[0] != "put":
            return f"{BROKEN}unknown verb {words[0][:40]}\n"
        name = usual_name(" ".join(words[1:2] + words[4:]))
        try:
            n = int(words[2])
            ts = n * 1_000_000_000 if n < SECONDS_BELOW else n
        except (ValueError, IndexError):
            try:
                ts = parse_timestamp(words[2])
            except (QueryError, IndexError):
                return f"{BROKEN}put needs a time\n"
        try:
            float(words[3])
        except (ValueError, IndexError):
            return f"{BROKEN}put needs a value\n"
        if name is None:
            return f"{BROKEN}put needs a series name with tags\n"
        return None if self.times.take(name, ts) else f"{LATE}\n"


class UdpListener:
    """Datagrams of whole frames, gathered into a file every ``every`` seconds. A datagram that breaks the protocol is dropped and counted."""

    def __init__(self, folder: str, host: str = "127.0.0.1", port: int = 0, every: float = 0.5, roll: int = 64 << 20) -> None:
        self.out, self.every, self.dropped = Roll(Landing(folder), roll, every), every, 0
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind((host, port))
        self.socket.settimeout(every / 2)
        self.address = self.socket.getsockname()
        self.running = True
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        while self.running:
            try:
                data = self.socket.recv(65536)
                # a dictionary would only hold for its own datagram
                if data[:1] == b"*" or any(r[4] for r in parse_frames(data)):
                    self.dropped += 1
                else:
                    self.out.add(data)
            except TimeoutError:
                pass
            self.out.tick()
        self.out.flush()

    def close(self) -> None:
        self.running = False
        self.thread.join(self.every + 5)
        self.socket.close()
