"""Newest-first reading of JSON-lines logs with one file a day.

Day files sort by name, so the newest entries are at the end of the last one.
``newest`` opens files from there, one, then two, then four at a time, until it
has enough; a file is read in blocks from its end and only as far as wanted.
``entries`` reads whole files for larger questions, in byte ranges that executors
share.  The files are local ones or on a mount that all executors see.

Lines that are no JSON object are passed over, and so are files that cannot be
read.  A line may span blocks and ranges; it belongs to the range it begins in.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kindred.sources.logs import NOTIFICATION

PREFIX, SUFFIX = "notifications-", ".log"
BLOCK = 64 << 10
RANGE = 64 << 20
SCHEMA = f"{NOTIFICATION}, file string, place bigint"
TEXTS = ("level", "category", "title", "message", "details")


def day_files(folder: str, *, since: date | None = None, until: date | None = None, prefix: str = PREFIX) -> list[str]:
    """Paths of the log's files, newest day first."""
    if not os.path.isdir(folder):
        return []
    names = sorted((n for n in os.listdir(folder) if n.startswith(prefix) and n.endswith(SUFFIX)), reverse=True)
    first, last = (f"{prefix}{d.isoformat()}{SUFFIX}" if d else None for d in (since, until))
    return [os.path.join(folder, n) for n in names if (first is None or n >= first) and (last is None or n <= last)]


def lines_from_end(path: str, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(place, line) from the last to the first, reading no block before it is needed."""
    with open(path, "rb") as file:
        at = file.seek(0, os.SEEK_END)
        late: list[bytes] = []  # what is known of a line whose beginning is not
        while at:
            size = min(block, at)
            at -= size
            file.seek(at)
            parts = file.read(size).split(b"\n")
            place = at + size
            for i in range(len(parts) - 1, 0, -1):
                place -= len(parts[i])
                line = b"".join([parts[i], *reversed(late)])
                late = []
                if line:
                    yield place, line
                place -= 1
            late.append(parts[0])
        line = b"".join(reversed(late))
        if line:
            yield 0, line


def lines_of_range(path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in [start, stop)."""
    with open(path, "rb") as file:
        if start:
            file.seek(start - 1)
            file.readline()
        while (place := file.tell()) < stop and (line := file.readline()):
            yield place, line.rstrip(b"\n")


def entry(line: bytes, file: str, place: int) -> tuple | None:
    """A row of the log, or None for a malformed line."""
    try:
        given = json.loads(line)
    except ValueError:
        return None
    if not isinstance(given, dict):
        return None
    try:
        when = datetime.fromisoformat(str(given.get("timestamp")))
        when = when.replace(tzinfo=when.tzinfo or UTC)
    except ValueError:
        when = None
    texts = (None if given.get(c) is None else str(given[c]) for c in TEXTS)
    return (None if given.get("id") is None else str(given["id"]), when, *texts, file, place)


@dataclass
class Piece(InputPartition):
    path: str
    start: int = 0
    stop: int = -1


class DayLog(DataSource):
    """Options: files (JSON list of paths), limit (entries wanted of each, from its end), range (bytes a partition)."""

    @classmethod
    def name(cls) -> str:
        return "day_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DayLogReader(dict(self.options))


class DayLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options.get("files", "[]"))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.range = int(options.get("range", RANGE))

    def partitions(self) -> list[Piece]:
        if self.limit is not None:
            return [Piece(p) for p in self.files]
        sizes = ((p, os.path.getsize(p)) for p in self.files if os.access(p, os.R_OK))
        return [Piece(p, at, min(at + self.range, size)) for p, size in sizes for at in range(0, size, self.range)]

    def read(self, piece: Piece | None) -> Iterator[tuple]:
        if piece is None:
            return
        name, found = os.path.basename(piece.path), 0
        try:
            lines = lines_from_end(piece.path) if self.limit is not None else lines_of_range(piece.path, piece.start, piece.stop)
            for place, line in lines:
                if found == self.limit:
                    return
                if row := entry(line, name, place):
                    found += 1
                    yield row
        except OSError:
            return


def _read(spark: SparkSession, files: list[str], **options) -> DataFrame:
    spark.dataSource.register(DayLog)
    reader = spark.read.format("day_log").option("files", json.dumps(files))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def entries(spark: SparkSession, folder: str, *, since: date | None = None, until: date | None = None, range_bytes: int = RANGE) -> DataFrame:
    """All entries of the days from ``since`` to ``until``; other days' files are not opened."""
    return _read(spark, day_files(folder, since=since, until=until), range=range_bytes)


def newest(spark: SparkSession, folder: str, limit: int = 50, *, since: date | None = None) -> DataFrame:
    """The ``limit`` newest entries, newest first: by file, then by place in it."""
    files, rows, at, step = day_files(folder, since=since), [], 0, 1
    while at < len(files) and len(rows) < limit:
        some = _read(spark, files[at : at + step], limit=limit - len(rows))
        rows += some.orderBy(F.desc("file"), F.desc("place")).limit(limit - len(rows)).collect()
        at, step = at + step, step * 2
    return spark.createDataFrame(rows, SCHEMA)


def append(folder: str, given: dict, *, now: datetime | None = None, prefix: str = PREFIX) -> str:
    """Add one entry to its day's file and return the file's path; the line is written by one call."""
    when = (now or datetime.now(UTC)).astimezone(UTC)
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{prefix}{when.date().isoformat()}{SUFFIX}")
    line = json.dumps({**given, "timestamp": when.isoformat(timespec="milliseconds").replace("+00:00", "Z")}, ensure_ascii=False) + "\n"
    out = os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o644)
    try:
        os.write(out, line.encode())
    finally:
        os.close(out)
    return path
