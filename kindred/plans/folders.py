"""Watched folders: overlap checks and directory sizes."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame


def ancestors(path: str):
    """All directories above a path, itself included, as an array column."""
    parts = F.split(F.col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def add_folder(folders: DataFrame, path: str, include_subfolders: bool = True) -> DataFrame:
    """The table with one more folder; one that is, holds or lies in a watched folder is an error."""
    fresh = folders.sparkSession.createDataFrame([(path, include_subfolders)], "path string, include_subfolders boolean")
    conflict = folder_conflicts(folders, fresh).first()
    if conflict is not None:
        raise ValueError(f"{path} is {conflict['kind']} {conflict['existing_path']}" if conflict["kind"] != "same" else f"{path} is watched already")
    return folders.unionByName(fresh, allowMissingColumns=True)


def remove_folder(folders: DataFrame, path: str) -> DataFrame:
    """The table without a folder; an unknown one is an error."""
    if not folders.where(F.col("path") == path).limit(1).count():
        raise KeyError(path)
    return folders.where(F.col("path") != path)


def folder_conflicts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(new_path, existing_path, kind): same, inside or around an existing folder.

    Prefix containment is an equi-join of one side with the other's ancestors.
    """
    old = existing.select(F.col("path").alias("existing_path")).distinct()
    fresh = new.select(F.col("path").alias("new_path")).distinct()
    inside = fresh.withColumn("existing_path", F.explode(ancestors("new_path"))).join(old, "existing_path")
    around = old.withColumn("new_path", F.explode(ancestors("existing_path"))).join(fresh, "new_path")
    inside = inside.select("new_path", "existing_path", F.when(F.col("new_path") == F.col("existing_path"), "same").otherwise("inside").alias("kind"))
    around = around.where(F.col("new_path") != F.col("existing_path")).select("new_path", "existing_path", F.lit("around").alias("kind"))
    return inside.unionByName(around)
