"""Exact folder listings as a Spark data source.

``binaryFile`` hides empty files and names that begin with ``_``; this source
gives every file of the wanted extensions, and for what it could not list a row
with the reason.  Folders are local ones or mounts that all executors see.

A partition is a directory's own entries, a whole subtree, or a share of the
entries of a directory with very many (by a hash of their names).  The driver
opens directories only until there are ``spread`` partitions and looks at no
more than ``PEEK`` entries of each, so planning stays small for trees of any
size; executors do the walking.

Two rules of listing are named: ``photo_files`` follows links, takes hidden
names and passes over what cannot be read; ``rename_files`` does neither and
fails on it.  A link back to one of its own ancestors is a reason, not a loop.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kindred.sources.files import EXTENSIONS

PEEK = 1000
ROWS = 4096
TRASH = ".trash"
SCHEMA = "path string, dir string, filename string, ext string, size bigint, modified timestamp, reason string"
ARROW = pa.schema([*((c, pa.string()) for c in ("path", "dir", "filename", "ext")), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("reason", pa.string())])


@dataclass
class Unit(InputPartition):
    """The entries of ``folder`` whose name falls into ``part`` of ``parts``, with all below them if ``deep``.

    ``above`` has the real paths of the folders it is in.  If ``taken_apart``,
    subfolders are other units' but for links, whose ancestors only this one knows.
    """

    folder: str
    deep: bool
    above: tuple[str, ...]
    part: int = 0
    parts: int = 1
    taken_apart: bool = False


class FolderListing(DataSource):
    """Options: folders (JSON pairs of path and depth), extensions, hidden, links, strict, trash, spread."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(dict(self.options))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folders = [(os.path.abspath(p), bool(deep)) for p, deep in json.loads(options.get("folders", "[]"))]
        self.extensions = frozenset(json.loads(options.get("extensions", "null")) or EXTENSIONS)
        self.hidden, self.links, self.strict = (options.get(k, d) == "true" for k, d in (("hidden", "true"), ("links", "true"), ("strict", "false")))
        self.trash, self.spread = options.get("trash", TRASH), int(options.get("spread", "64"))

    def partitions(self) -> list[Unit]:
        units: list[Unit] = []
        waiting = deque(Unit(folder, deep, ()) for folder, deep in self.folders)
        while waiting:
            unit = waiting.popleft()
            if len(units) + len(waiting) >= self.spread:
                units.append(unit)
                continue
            try:
                with os.scandir(unit.folder) as entries:
                    seen = list(islice(entries, PEEK + 1))
            except OSError:
                seen = []  # its reader tells
            if len(seen) > PEEK:
                units += [replace(unit, part=k, parts=self.spread) for k in range(self.spread)]
                continue
            units.append(replace(unit, taken_apart=True))
            if unit.deep:
                above = (*unit.above, os.path.realpath(unit.folder))
                waiting.extend(Unit(e.path, True, above) for e in seen if self._wanted(e.name) and e.name != self.trash and e.is_dir(follow_symlinks=False))
        return units

    def _wanted(self, name: str) -> bool:
        return self.hidden or not name.startswith(".")

    def read(self, unit: Unit | None) -> Iterator[pa.RecordBatch]:
        if unit is None:  # no folders
            return
        rows: list[tuple] = []
        for row in self._walk(unit.folder, unit, (*unit.above, os.path.realpath(unit.folder))):
            rows.append(row)
            if len(rows) == ROWS:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ARROW)], schema=ARROW)

    def _failed(self, path: str, reason: str) -> tuple:
        if self.strict:
            raise OSError(f"{path}: {reason}")
        return (path, os.path.dirname(path), os.path.basename(path), None, None, None, reason)

    def _walk(self, folder: str, unit: Unit, above: tuple[str, ...]) -> Iterator[tuple]:
        """Rows of a folder; ``above`` has the real paths of the folders it is in."""
        top = len(above) == len(unit.above) + 1
        try:
            entries = os.scandir(folder)
        except OSError as error:
            if not top or unit.part == 0:
                yield self._failed(folder, error.strerror or "unreadable")
            return
        with entries:
            for entry in entries:
                if not self._wanted(entry.name) or top and unit.parts > 1 and zlib.crc32(os.fsencode(entry.name)) % unit.parts != unit.part:
                    continue
                link = entry.is_symlink()
                if link and not self.links:
                    continue
                try:
                    info = entry.stat()
                    folder_there, file_there = entry.is_dir(), entry.is_file()
                except OSError as error:
                    yield self._failed(entry.path, error.strerror or "cannot be read")
                    continue
                ext = os.path.splitext(entry.name)[1].lower()
                if file_there and ext in self.extensions:
                    yield (entry.path, folder, entry.name, ext, info.st_size, int(info.st_mtime * 1_000_000), None)
                elif folder_there and unit.deep and entry.name != self.trash and (link or not (top and unit.taken_apart)):
                    real = os.path.realpath(entry.path)
                    if real in above:
                        yield self._failed(entry.path, "link to a folder it is in")
                    else:
                        yield from self._walk(entry.path, unit, (*above, real))


def listing(spark: SparkSession, folders: list[tuple[str, bool]], **options) -> DataFrame:
    """All rows of the source for (folder, with subfolders) pairs; folders that overlap give a file twice."""
    spark.dataSource.register(FolderListing)
    reader = spark.read.format("folder_listing").option("folders", json.dumps(folders))
    for name, value in options.items():
        reader = reader.option(name, str(value).lower() if isinstance(value, bool) else json.dumps(value) if isinstance(value, (list, tuple)) else str(value))
    return reader.load()


def photo_files(spark: SparkSession, folders: list[tuple[str, bool]], **options) -> DataFrame:
    """Images to scan; folders and files that cannot be read are left out."""
    return listing(spark, folders, **options).where(F.col("reason").isNull()).drop("reason")


def rename_files(spark: SparkSession, folder: str, recursive: bool, **options) -> DataFrame:
    """Images to rename, without hidden names and links; a folder that cannot be read is an error."""
    return listing(spark, [(folder, recursive)], hidden=False, links=False, strict=True, trash="", **options).drop("reason")


def skipped_files(listed: DataFrame) -> DataFrame:
    """(path, reason) of what a scan cannot use, each path once: not listed, or empty."""
    reason = F.coalesce("reason", F.when(F.col("size") == 0, "empty"))
    return listed.select("path", reason.alias("reason")).where(F.col("reason").isNotNull()).groupBy("path").agg(F.min("reason").alias("reason"))
