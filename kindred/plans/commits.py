"""Changes of several stored tables at once: scan results, rename jobs, clearing."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from kindred.sources.store import Snapshot, Store

SCAN_TABLES = ("trash", "photos", "groups", "scans")
RENAME_TABLES = ("rename_jobs", "renames")


def save_scan(store: Store, scan_id: int, groups: DataFrame, photos: DataFrame) -> Snapshot:
    """Groups and photos of a scan take the place of the stored ones.

    Old trash rows name photos that are gone, so they go too; the scan's row
    gets its number of groups.  Readers see all of it or nothing.
    """
    base = store.snapshot()
    found = groups.agg(F.count("*").alias("_found")).withColumn("_scan", F.lit(scan_id))
    scans = base.table("scans")
    counted = scans.join(found, F.col("id") == F.col("_scan"), "left").withColumn("discovered_groups", F.coalesce("_found", "discovered_groups")).select(*scans.columns)
    return store.commit({"groups": groups, "photos": photos, "trash": base.table("trash").where("false"), "scans": counted}, base=base)


def clear_scan_history(store: Store) -> Snapshot:
    """No trash, photos, groups or scans."""
    return store.clear(*SCAN_TABLES)


def clear_rename_history(store: Store) -> Snapshot:
    """No rename jobs and no renames."""
    return store.clear(*RENAME_TABLES)


def save_rename_job(store: Store, job_id: int, plan: DataFrame, total: int, at: Column) -> Snapshot:
    """Add an executed job and its renames (``plan`` has original_path and renamed_path)."""
    job = plan.agg(F.count("*").alias("renamed")).select(
        F.lit(job_id).cast("bigint").alias("id"),
        F.lit("completed").alias("status"),
        F.lit(total).cast("bigint").alias("total"),
        "renamed",
        (F.lit(total) - F.col("renamed")).alias("skipped"),
        at.alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("undone_at"),
    )
    renames = plan.select(F.lit(job_id).cast("bigint").alias("job_id"), "original_path", "renamed_path")
    return store.commit(append={"rename_jobs": job, "renames": renames})


def undo_rename_job(store: Store, job_id: int, at: Column) -> Snapshot:
    """Mark a completed job as undone; other jobs stay as they are."""
    base = store.snapshot()
    hit = (F.col("id") == job_id) & (F.col("status") == "completed")
    jobs = base.table("rename_jobs")
    marked = jobs.withColumn("undone_at", F.when(hit, at).otherwise(F.col("undone_at"))).withColumn("status", F.when(hit, "undone").otherwise(F.col("status")))
    return store.commit({"rename_jobs": marked}, base=base)
