"""Dashboard numbers and scan history."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame


def dashboard(photos: DataFrame, groups: DataFrame, scans: DataFrame) -> DataFrame:
    """One row: photos, groups, reclaimable bytes and the latest scan."""
    counts = photos.agg(F.count("*").alias("total_photos"))
    sizes = groups.agg(F.count("*").alias("total_groups"), F.coalesce(F.sum("reclaimable_size"), F.lit(0)).alias("reclaimable_size"))
    last = scans.agg(F.max_by("id", F.struct("started_at", "id")).alias("last_scan_id"), F.max("started_at").alias("last_scan_at"))
    return counts.join(F.broadcast(sizes), how="left").join(F.broadcast(last), how="left")  # one row each


def scan_history(scans: DataFrame, groups: DataFrame, limit: int = 10) -> DataFrame:
    """The latest scans, each with the review progress."""
    progress = groups.agg(F.count_if(F.col("review_status") == "reviewed").alias("reviewed_groups"), F.count("*").alias("total_groups"))
    return scans.orderBy(F.desc("started_at"), F.desc("id")).limit(limit).join(F.broadcast(progress), how="left")  # one row


def progress(elapsed: Column, processed: Column, total: Column) -> tuple[Column, Column, Column]:
    """(files a second, seconds remaining, percent), 0 where undefined."""
    speed = F.when(elapsed > 0, processed / elapsed).otherwise(0.0)
    remaining = F.when(speed > 0, (total - processed) / speed).otherwise(0.0)
    percent = F.when(total > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.round(processed / total * 100).cast("int")))).otherwise(0)
    return speed, remaining, percent


def page_count(total: Column, size: int) -> Column:
    return F.ceil(total / size)


def storage(files: DataFrame, size: str, parts: list[str]) -> DataFrame:
    """Bytes and files below each directory."""
    return files.groupBy(*parts).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
