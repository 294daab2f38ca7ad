"""Soft deletion: listing, summary, expiry and the changes as new tables."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from kindred.catalog import RETENTION_DAYS


def trash_page(trash: DataFrame, *, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of trashed items, last deleted first; ties by id and size; ``total`` counts them all."""
    held = trash.where(F.col("status") == "trashed")
    page = held.orderBy(F.desc("deleted_at"), "trash_id", "size").offset(offset).limit(limit)
    return page.join(F.broadcast(held.agg(F.count("*").alias("total"))), how="left")  # one row


def trash_summary(trash: DataFrame) -> DataFrame:
    """Count, bytes and next expiry of what is in the trash, in one pass."""
    return trash.where(F.col("status") == "trashed").agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.min("expires_at").alias("next_cleanup"))


def expired(trash: DataFrame, now: Column) -> DataFrame:
    """Trashed items strictly past their retention."""
    return trash.where((F.col("status") == "trashed") & (F.col("expires_at") < now))


def purge(trash: DataFrame, which: Column) -> DataFrame:
    """The table after the trashed rows of ``which`` are deleted for good."""
    hit = (F.col("status") == "trashed") & which
    return trash.withColumn("status", F.when(hit, "purged").otherwise(F.col("status")))


def restore(trash: DataFrame, which: Column, now: Column) -> DataFrame:
    """The table after the trashed rows of ``which`` are restored."""
    hit = (F.col("status") == "trashed") & which
    return trash.withColumn("restored_at", F.when(hit, now)).withColumn("status", F.when(hit, "restored").otherwise(F.col("status")))


def restorable(trash: DataFrame, photos: DataFrame) -> DataFrame:
    """Trashed items with their photo's group."""
    return trash.where(F.col("status") == "trashed").join(photos.select(F.col("id").alias("photo_id"), "group_id", "filename"), "photo_id").select("group_id", "photo_id", "trash_id", "filename", "size")


def move_to_trash(photos: DataFrame, trash: DataFrame, which: Column, now: Column) -> DataFrame:
    """New trash rows for the photos of ``which`` that are not in the trash already."""
    active = trash.where(F.col("status") == "trashed").select(F.col("photo_id").alias("id"))
    fresh = photos.where(which).join(active, "id", "left_anti")
    return fresh.select(F.col("id").alias("photo_id"), "filename", F.col("file_size").alias("size"), F.lit("trashed").alias("status"), now.alias("deleted_at"), (now + F.expr(f"INTERVAL {RETENTION_DAYS} DAYS")).alias("expires_at"))
