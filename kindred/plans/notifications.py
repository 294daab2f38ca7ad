"""Notification log: listing with read state, throttling, discovery, templates."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

# Category, level and template of each command's outcomes.
POLICY = {
    ("scan.start", "success"): ("scan", "success", "{processedFiles} files processed, {groupCount} groups found"),
    ("scan.start", "error"): ("scan", "error", "Scan failed: {error}"),
    ("scan.start", "abort"): ("scan", "info", "Scan cancelled by user"),
    ("organize.execute", "success"): ("organize", "success", "{renamedFiles} files renamed ({totalFiles} total)"),
    ("organize.execute", "error"): ("organize", "error", "File organization failed: {error}"),
    ("organize.undo", "success"): ("organize", "info", "{restoredCount} files restored to original names"),
    ("organize.undo", "error"): ("organize", "error", "Undo failed: {error}"),
    ("trash.empty", "success"): ("trash", "info", "Trash emptied: {deletedCount} items permanently deleted"),
    ("trash.empty", "error"): ("trash", "error", "Failed to empty trash: {error}"),
}


def outcome(failed: Column, message: Column) -> Column:
    """``success``, ``abort`` or ``error``; an error that tells of an abort is one."""
    return F.when(~failed, "success").when(F.contains(F.coalesce(message, F.lit("")), F.lit("aborted")), "abort").otherwise("error")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace {key} by its value; unknown keys and nulls stay."""
    out = template
    for key, value in values.items():
        out = F.replace(out, F.lit(f"{{{key}}}"), F.coalesce(value.cast("string"), F.lit(f"{{{key}}}")))
    return out


def recent(log: DataFrame, limit: int, read_ids: DataFrame, cleared_at: Column | None = None) -> DataFrame:
    """The newest entries after the last clearing, with their read flag."""
    newest = log.orderBy(F.desc("ts"), F.desc("id")).limit(limit)
    shown = newest if cleared_at is None else newest.where(F.col("ts") > cleared_at)
    return with_read_flag(shown, read_ids)


def with_read_flag(log: DataFrame, read_ids: DataFrame) -> DataFrame:
    flag = read_ids.select("id").distinct().withColumn("_read", F.lit(True))
    return log.join(flag, "id", "left").withColumn("is_read", F.coalesce("_read", F.lit(False))).drop("_read")


def mark_read(read_ids: DataFrame, more: DataFrame) -> DataFrame:
    return read_ids.select("id").union(more.select("id")).distinct()


def throttle(events: DataFrame, key: str, interval_ms: int = 200) -> DataFrame:
    """Leading-edge throttle per key: an event passes if the last passed one is far enough: (key, id, ts).

    Whether an event passes depends on the ones before it, so a key's events
    are read in order; only the last passed time is held, whatever their
    number.  Events without a time are left out; those without a key are one
    key's.
    """
    gap = interval_ms * 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last = None, 0
        for batch in batches:
            keys = batch.column("key").to_pylist()
            t = batch.column("ts").cast(pa.int64()).to_numpy()
            keep, at = [], 0
            while at < len(keys):
                stop = bisect_right(keys, False, at, key=lambda k, own=keys[at]: k != own) if keys[at] != keys[-1] else len(keys)
                if here is not None and here[0] == keys[at]:
                    at += int(np.searchsorted(t[at:stop], last + gap))
                while at < stop:
                    here, last = (keys[at],), t[at]
                    keep.append(at)
                    at += max(1, int(np.searchsorted(t[at:stop], last + gap)))
                at = stop
            yield batch.take(pa.array(keep, pa.int64()))

    rows = events.select(F.col(key).alias("key"), "id", F.col("ts").cast("timestamp_ntz").alias("ts")).where(F.col("ts").isNotNull())
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "ts", "id")
    return sorted_rows.mapInArrow(run, rows.schema)


def unread_count(log: DataFrame, read_ids: DataFrame, cleared_at: Column | None = None) -> DataFrame:
    """One row: entries after the last clearing, and how many of them are unread."""
    shown = log if cleared_at is None else log.where(F.col("ts") > cleared_at)
    return with_read_flag(shown, read_ids).agg(F.count("*").alias("entries"), F.count_if(~F.col("is_read")).alias("unread"))


def discoveries(events: DataFrame, key: str, counter: Column) -> DataFrame:
    """Events whose counter is above the one before, per key."""
    order = Window.partitionBy(key).orderBy("ts", "id")
    return events.withColumn("counter", counter).withColumn("before", F.lag("counter").over(order)).where(F.col("counter") > F.coalesce("before", F.lit(0)))
