"""Group review: listing, detail, pending deletions, master and decision changes."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from kindred.storage import materialise

GROUP_COLUMNS = ("id", "file_count", "total_size", "reclaimable_size", "review_status", "decision")


def matching_groups(photos: DataFrame, search: str) -> DataFrame:
    """Ids of groups with a file name like ``%search%``, case folded."""
    return photos.where(F.ilike("filename", F.lit(f"%{search}%"))).select(F.col("group_id").alias("id")).distinct()


def has_purged(photos: DataFrame, trash: DataFrame) -> DataFrame:
    """Ids of groups with a permanently deleted photo."""
    gone = trash.where(F.col("status") == "purged").select(F.col("photo_id").alias("_photo"))
    return photos.join(gone, photos["id"] == gone["_photo"], "left_semi").select(F.col("group_id").alias("id")).distinct()


def list_groups(groups: DataFrame, photos: DataFrame, trash: DataFrame, *, offset: int = 0, limit: int | None = 50, search: str = "", status: str | None = None) -> DataFrame:
    """A page of groups with their master's file name, by id.

    Column ``total`` counts all groups that match; a total order by id makes
    pages disjoint.  Only the page's groups look up names and purged photos.
    """
    found = groups.where(F.col("review_status") == status) if status else groups
    if search:
        found = found.join(matching_groups(photos, search), "id", "left_semi")
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy("id").offset(offset)
    if limit is not None:
        page = materialise(page.limit(limit), "page")
        photos = photos.join(F.broadcast(page.select(F.col("id").alias("group_id"))), "group_id", "left_semi")  # at most ``limit`` rows
    masters = photos.where("is_master").select(F.col("id").alias("master_id"), F.col("filename").alias("master_filename"))
    purged = has_purged(photos, trash).withColumn("_purged", F.lit(True))
    named = page.join(masters, "master_id", "left").join(purged, "id", "left")
    out = named.select(*GROUP_COLUMNS, F.coalesce("_purged", F.lit(False)).alias("has_purged"), F.coalesce("master_filename", F.lit("")).alias("master_filename"))
    return out.join(F.broadcast(total), how="left")  # one row


def group_detail(photos: DataFrame, trash: DataFrame, group_ids: Column | None = None) -> DataFrame:
    """Photos of the groups with their trash rows; ``place`` 1 is a group's best quality.

    A photo that went to the trash more than once appears once per trash row.
    """
    chosen = photos if group_ids is None else photos.where(group_ids)
    rows = chosen.join(trash, chosen["id"] == trash["photo_id"], "left")
    return rows.select("group_id", "id", "filename", "file_size", "quality", "is_master", "trash_id", F.col("status").alias("trash_status"), F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("quality"), "id", "trash_id")).alias("place"))


def pending_deletions(photos: DataFrame, groups: DataFrame, trash: DataFrame) -> DataFrame:
    """Duplicates of decided groups that are not in the trash, or were restored."""
    decided = groups.where(F.col("decision") == "duplicates_deleted").select(F.col("id").alias("group_id"))
    rows = photos.where(~F.col("is_master")).join(decided, "group_id")
    rows = rows.join(trash.select("photo_id", "trash_id", "status"), rows["id"] == trash["photo_id"], "left")
    return rows.where(F.col("trash_id").isNull() | (F.col("status") == "restored")).select(F.col("id").alias("photo_id"), "filename", "file_size", "group_id")


def pending_size(pending: DataFrame) -> DataFrame:
    """One row: photos still to be deleted, each once, and their bytes."""
    return pending.groupBy("photo_id").agg(F.max("file_size").alias("size")).agg(F.count("*").alias("photos"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def change_master(photos: DataFrame, groups: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(photos, groups) after ``chosen`` (group_id, photo_id) become masters.

    Pairs whose photo is not in the group are ignored.
    """
    valid = photos.select(F.col("id").alias("photo_id"), "group_id", F.col("file_size").alias("_size")).join(chosen, ["group_id", "photo_id"], "left_semi")
    marked = photos.join(valid.select("group_id", F.col("photo_id").alias("_new")), "group_id", "left")
    after = marked.withColumn("is_master", F.coalesce(F.col("id") == F.col("_new"), F.col("is_master"))).drop("_new")
    moved = groups.join(valid.select(F.col("group_id").alias("id"), F.col("photo_id").alias("_new"), "_size"), "id", "left")
    moved = moved.withColumn("reclaimable_size", F.coalesce(F.col("total_size") - F.col("_size"), F.col("reclaimable_size"))).withColumn("master_id", F.coalesce("_new", "master_id"))
    return after, moved.drop("_new", "_size")


def mark_reviewed(groups: DataFrame, which: Column, decision: str | None, now: Column) -> DataFrame:
    """Mark groups reviewed; without a decision an earlier one is cleared."""
    given = F.lit(decision).cast("string")
    return (
        groups.withColumn("reviewed_at", F.when(which, now))
        .withColumn("decided_at", F.when(which & given.isNotNull(), now))
        .withColumn("decision", F.when(which, given).otherwise(F.col("decision")))
        .withColumn("review_status", F.when(which, "reviewed").otherwise(F.col("review_status")))
    )


def best_duplicate(photos: DataFrame) -> DataFrame:
    """The best photo of each group besides its master."""
    return photos.where(~F.col("is_master")).groupBy("group_id").agg(F.max_by("id", F.struct("quality", -F.col("id"))).alias("photo_id"), F.max("quality").alias("quality"))
