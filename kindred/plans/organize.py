"""Renaming by date: collision-free names, execution and undo as plans."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import inf

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.types import LongType, StructField, StructType

KEY = ("dir", "date_name", "low_ext")
GIVEN = ("seq", "path", "dir", "date_name", "ext")
DATE_NAME = 17  # characters of a date name


def date_source(original: Column, created: Column, birth: Column, modified: Column) -> tuple[Column, Column]:
    """(date, ``exif`` or ``file``): metadata first, then birth time if after the epoch, then change time."""
    known = F.coalesce(original, created)
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.coalesce(known, F.when(birth > zero, birth), modified), F.when(known.isNotNull(), "exif").otherwise("file")


def date_name(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd_HHmmss")


def numbered_tail(number: Column) -> Column:
    """``_007``; numbers of more than three digits stay whole."""
    return F.format_string("_%03d", number)


def keyed(files: DataFrame) -> DataFrame:
    """Add date_name and low_ext; ``files`` has seq, dir, ext, path and date."""
    return files.withColumn("date_name", date_name(F.col("date"))).withColumn("low_ext", F.lower("ext"))


def named(files: DataFrame) -> DataFrame:
    """``keyed`` with the number of files of the same key."""
    return keyed(files).withColumn("same", F.count("*").over(Window.partitionBy(*KEY)))


def rename_plan(files: DataFrame) -> DataFrame:
    """New path of every file whose name changes; numbers only on collisions.

    The count and the number share one partitioning by (dir, name, extension).
    """
    order = Window.partitionBy(*KEY).orderBy("seq")
    number = F.when(F.col("same") > 1, numbered_tail(F.row_number().over(order))).otherwise("")
    planned = named(files).withColumn("renamed_path", F.concat("dir", F.lit("/"), "date_name", number, "ext"))
    return planned.where(F.col("renamed_path") != F.col("path")).select("seq", F.col("path").alias("original_path"), "renamed_path")


def _name_parts(path: Column) -> list[Column]:
    """Directory, date name, extension and number of a path that a rename could have made; 0 without number, null for other names."""
    name = F.substring_index(path, "/", -1)
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    tail = F.substring(name, F.lit(DATE_NAME + 1), F.length(name) - DATE_NAME - F.length(ext))
    number = F.substring(tail, 2, 20).try_cast("long")
    n = F.when(tail == "", F.lit(0).cast("long")).when((number > 0) & (tail == numbered_tail(number)), number)
    return [F.regexp_replace(path, "/[^/]*$", "").alias("dir"), F.substring(name, 1, DATE_NAME).alias("date_name"), ext.alias("ext"), n.alias("n")]


def _give_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the files of each key, 0 for the plain name.

    Rows come by key and number: names in use (mark 0) by their own, files
    (mark 1) by their place, below which none takes a number.  The file that
    has waited longest is offered each number in turn; those that wait are as
    many as numbers were skipped.
    """
    key, number, used, used_at = None, 1, set(), None
    waiting: deque = deque()

    def offer(until: float) -> Iterator[tuple]:
        """Files that take a number below ``until``."""
        nonlocal number
        while waiting and number < until:
            ext, own = waiting[0][:2]
            if used_at != number or ext not in used or own == number:
                yield (*waiting.popleft()[2:], number)
            number += 1

    types = None
    for batch in batches:
        types = types or [batch.schema.field(c).type for c in GIVEN] + [pa.int64()]
        given: list[tuple] = []
        for d, date, low_ext, at, mark, many, home, own, *row in zip(*(batch.column(c).to_pylist() for c in (*KEY, "at", "mark", "many", "home", "own", *GIVEN)), strict=True):
            if (d, date, low_ext) != key:
                given += offer(inf)
                key, number, used, used_at, plain = (d, date, low_ext), 1, set(), None, set()
            if at != used_at:
                given += offer(at)
                used, used_at = set(), at
            ext = row[-1]
            if not mark:
                (used if at else plain).add(ext)
            elif many or (ext in plain and not home):
                waiting.append((ext, own, *row))
            else:
                given.append((*row, 0))
        yield _given_batch(given, types)
    if types:
        yield _given_batch(list(offer(inf)), types)


def _given_batch(given: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*given, strict=True) if given else ([] for _ in types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*GIVEN, "n"])


def rename_plan_around(files: DataFrame, occupied: DataFrame) -> DataFrame:
    """As ``rename_plan``, skipping names of ``occupied`` (path) and names given already.

    One by one, a file takes the next number of its (directory, date name,
    extension) that is not occupied by another file.  Files and names in use
    meet once, by key, and each key is gone through in order of numbers, so
    what is shuffled does not depend on how many names are skipped.
    Files without date or path keep their names.
    """
    own_dir, own_date, own_ext, own_n = _name_parts(F.col("path"))
    own = F.when((own_dir == F.col("dir")) & (own_date == F.col("date_name")) & (own_ext == F.col("ext")), own_n)
    asking = keyed(files).where(F.col("date_name").isNotNull()).select(*KEY, "seq", "path", "ext", F.lit(1).alias("mark"))
    used = occupied.select(*_name_parts(F.col("path"))).where("n IS NOT NULL").withColumn("low_ext", F.lower("ext")).withColumn("mark", F.lit(0))
    both = asking.unionByName(used, allowMissingColumns=True).repartition(*KEY)
    order = Window.partitionBy(*KEY, "mark").orderBy("seq", "path")
    placed = both.withColumn("place", F.row_number().over(order).cast("long")).withColumn("many", (F.col("place") > 1) | F.lead(F.lit(1)).over(order).isNotNull())
    home = F.coalesce(F.col("path") == F.concat("dir", F.lit("/"), "date_name", "ext"), F.lit(False))
    rows = placed.select(*KEY, "seq", "path", "ext", "mark", "many", F.when(F.col("mark") == 1, F.col("place")).otherwise(F.col("n")).alias("at"), home.alias("home"), F.when(F.col("mark") == 1, own).alias("own"))
    given = rows.sortWithinPartitions(*KEY, "at", "mark").mapInArrow(_give_numbers, StructType([*(rows.schema[c] for c in GIVEN), StructField("n", LongType())]))
    number = F.when(F.col("n") > 0, numbered_tail(F.col("n"))).otherwise("")
    renamed = given.select("seq", F.col("path").alias("original_path"), F.concat("dir", F.lit("/"), "date_name", number, "ext").alias("renamed_path"))
    return renamed.where(F.col("renamed_path") != F.col("original_path"))


def rename_job(plan: DataFrame, total: int) -> DataFrame:
    """One row: files seen, renamed and skipped."""
    return plan.agg(F.count("*").alias("renamed")).select(F.lit(total).cast("long").alias("total"), "renamed", (F.lit(total) - F.col("renamed")).alias("skipped"))


def undo_plan(renames: DataFrame, existing: DataFrame) -> DataFrame:
    """Renames whose target still exists, back to front."""
    return renames.join(existing.select(F.col("path").alias("renamed_path")), "renamed_path", "left_semi").select(F.col("renamed_path").alias("from_path"), F.col("original_path").alias("to_path"))
