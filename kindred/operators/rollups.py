"""Stored aggregates kept up to date from changed rows.

A ``Rollup`` stores one row for each combination of its keys: how many rows
there are and the sums of its measures.  A change is the rows it takes away and
the rows it puts in their place, so a fold reads the stored aggregate and the
changed rows, never the table.  A minimum over the table is the least key with
rows left, which deletions cannot spoil; counts and sums come from the same rows.

Null keys are groups like any other, null measures count as nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Rollup:
    keys: tuple[str, ...]
    measures: tuple[str, ...] = ()

    def _signed(self, rows: DataFrame, sign: int) -> DataFrame:
        sums = (F.coalesce(F.sum(m), F.lit(0)).cast("bigint") * sign for m in self.measures)
        return rows.groupBy(*self.keys).agg((F.count("*") * sign).alias("n"), *(s.alias(m) for s, m in zip(sums, self.measures, strict=True)))

    def build(self, rows: DataFrame) -> DataFrame:
        """The aggregate of a whole table."""
        return self._signed(rows, 1)

    def fold(self, stored: DataFrame, removed: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
        """The aggregate after ``removed`` rows went and ``added`` rows came.

        Taking away rows that were not there is an error, not a negative count.
        """
        now = stored
        for rows, sign in ((removed, -1), (added, 1)):
            if rows is not None:
                now = now.unionByName(self._signed(rows, sign))
        summed = now.groupBy(*self.keys).agg(F.sum("n").alias("n"), *(F.sum(m).alias(m) for m in self.measures))
        checked = F.when(F.col("n") < 0, F.raise_error(F.lit("more rows removed than there were")).cast("bigint")).otherwise(F.col("n"))
        return summed.withColumn("n", checked).where(F.col("n") != 0)


#: A4: what is in the trash, by the time it expires.
TRASH = Rollup(("status", "expires_at"), ("size",))
#: A5, A11: groups by what has been decided about them.
GROUPS = Rollup(("review_status", "decision"), ("file_count", "total_size", "reclaimable_size"))


def trash_summary(stored: DataFrame) -> DataFrame:
    """Count, bytes and next expiry of what is in the trash, from its rollup."""
    held = stored.where(F.col("status") == "trashed")
    return held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.min("expires_at").alias("next_cleanup"))


def review_summary(stored: DataFrame) -> DataFrame:
    """Groups, photos and bytes to reclaim: all, and of undecided groups."""
    total = lambda c, only: F.coalesce(F.sum(F.when(only, F.col(c))), F.lit(0))
    every, pending = F.lit(True), F.col("review_status") == "pending"
    return stored.agg(
        total("n", every).alias("total_groups"),
        total("file_count", every).alias("total_photos"),
        total("reclaimable_size", every).alias("reclaimable_size"),
        total("n", pending).alias("pending_groups"),
        total("reclaimable_size", pending).alias("pending_size"),
    )


def changed(rows: DataFrame, which: Column, **values: Column) -> tuple[DataFrame, DataFrame]:
    """(removed, added): the rows of ``which`` as they are and with new values."""
    hit = rows.where(which)
    return hit, hit.withColumns(values)
