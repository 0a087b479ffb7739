"""Growing session logs as a stream: a source that reads what was appended since the last micro-batch.

Spark's own file source sees new files, not bytes that are appended to known ones. Here an offset is the
length read of every log, up to its last line feed, so a half-written line waits for its end. Every
batch looks for new logs of the session, which are read from their beginning. The driver finds the last line feed by
reading backwards; the bytes themselves are read by executors, in ranges.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources import sessions

#: Bytes of a log that one task reads.
SPLIT_BYTES = 16 << 20
SCHEMA = sessions.LINES + ", label string, cwd string"


class SessionTail(DataSource):
    """``spark.readStream.format("session_tail")`` with the options ``log_dir``, ``session`` and ``start`` (earliest or latest)."""

    @classmethod
    def name(cls) -> str:
        return "session_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options["log_dir"], self.options["session"], self.options.get("start", "earliest"), int(self.options.get("split_bytes", SPLIT_BYTES)))


def last_line_end(path: str, floor: int, step: int = 1 << 16) -> int:
    """Where the last whole line of a file ends, looked for backwards from its end; ``floor`` if there is none after it."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > floor:
            start = max(floor, at - step)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return floor


@dataclass
class Range(InputPartition):
    """The lines of one log that begin in [start, stop); ``first`` is where the batch's own lines begin."""

    path: str
    rank: int
    first: int
    start: int
    stop: int


class _Reader(DataSourceStreamReader):
    """The driver looks at the ends of logs alone; ranges of their bytes are read, and cut into lines, by executors."""

    def __init__(self, log_dir: str, session: str, start: str, split_bytes: int):
        self.log_dir, self.session, self.begin, self.split_bytes = log_dir, session, start, split_bytes
        self.known: dict[str, list[int]] | None = None

    def initialOffset(self) -> dict:
        """Offsets are {file name: [rank, bytes read]}; ranks are given at first sight and stay."""
        self.known = self.known or {}
        return {"logs": json.dumps(self._ends({}) if self.begin == "latest" else {})}

    def latestOffset(self) -> dict:
        self.known = self._ends(self.known or {})
        return {"logs": json.dumps(self.known)}

    def _ends(self, known: dict[str, list[int]]) -> dict[str, list[int]]:
        after = dict(known)
        for path in sessions.session_files(self.log_dir, self.session):
            rank, done = after.get(path, [len(after), 0])
            # A log that shrank was written anew.
            after[path] = [rank, last_line_end(path, done if os.path.getsize(path) >= done else 0)]
        return after

    def partitions(self, start: dict, end: dict) -> list[Range]:
        known, out = json.loads(start["logs"]), []
        self.known = self.known or {}
        for path, (rank, stop) in json.loads(end["logs"]).items():
            done = known.get(path, [rank, 0])[1]
            done = done if stop >= done else 0
            self.known[path] = max([rank, stop], self.known.get(path, [rank, 0]), key=lambda x: x[1])
            out += [Range(path, rank, done, at, min(at + self.split_bytes, stop)) for at in range(done, stop, self.split_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        stem = Path(partition.path).stem
        label, cwd = _first(partition.path, stem)
        with open(partition.path, "rb") as f:
            at = partition.start
            if at > partition.first:  # a line that begins before this range is the range's before it
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.stop:
                line = f.readline()
                yield partition.rank, stem, 0, at, line.rstrip(b"\n").decode("utf-8", "replace"), label, cwd
                at += len(line)


def _first(path: str, stem: str) -> tuple[str, str | None]:
    """What a log's first line says of the agent and its folder, as ``sessions.first_lines`` has it."""
    label, cwd = sessions.default_label(stem), None
    with open(path, "rb") as f:
        try:
            first = json.loads(f.readline().decode("utf-8", "replace"))
        except ValueError:
            return label, cwd
    if isinstance(first, dict):
        message = first.get("message")
        text = message.get("content") if isinstance(message, dict) else None
        if isinstance(text, str) and text:
            line = text.split("\n")[0].removesuffix("\r")
            label = line if len(line.encode()) <= 50 else line.encode()[:47].decode("utf-8", "ignore") + "..."
        cwd = first["cwd"] if isinstance(first.get("cwd"), str) else None
    return label, cwd


def read_stream(spark: SparkSession, log_dir: str, session: str, start: str = "earliest") -> DataFrame:
    """The lines of a session's logs as they come, in the columns that ``sessions.parse_lines`` takes."""
    spark.dataSource.register(SessionTail)
    return spark.readStream.format("session_tail").option("log_dir", log_dir).option("session", session).option("start", start).load()


class SessionWatch:
    """Which session is to be followed: another one is, once it is newer than the one followed so far."""

    def __init__(self, log_dir: str, session: str | None = None):
        self.log_dir, self.session = log_dir, session or sessions.latest_session(log_dir)
        self.seen = self._time(self.session)

    def _time(self, session: str | None) -> float:
        path = Path(self.log_dir, f"{session}.jsonl")
        return path.stat().st_mtime if session and path.exists() else 0.0

    def switched(self) -> str | None:
        """The session to switch to, or None. The caller stops its query, resets its ledger and starts anew from the earliest line."""
        latest = sessions.latest_session(self.log_dir)
        if latest and latest != self.session and self._time(latest) >= self.seen:
            self.session, self.seen = latest, self._time(latest)
            return latest
        return None


class FileWatch:
    """Which files changed since the last look, by size and time: sources of a project, or caches."""

    def __init__(self, paths: list[str]):
        self.known = {p: self._mark(p) for p in paths}

    @staticmethod
    def _mark(path: str) -> tuple[int, int] | None:
        try:
            s = os.stat(path)
        except OSError:
            return None
        return s.st_size, s.st_mtime_ns

    def changed(self, paths: list[str]) -> list[str]:
        """Those of ``paths`` that are new or changed; files that are gone are not reported."""
        out = []
        for p in paths:
            mark = self._mark(p)
            if mark is not None and self.known.get(p) != mark:
                out.append(p)
                self.known[p] = mark
        return out
