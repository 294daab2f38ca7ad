"""Predicates of the metadata pre-filter and of the review screens.

Every builder returns a boolean Column without nulls; an inactive filter is a
constant true that Catalyst removes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame


def keywords(text: str) -> list[str]:
    """Comma-separated keywords, trimmed, lower-cased, empties dropped."""
    return [k for part in text.split(",") if (k := part.strip().lower())]


def in_dates(taken: Column, start: date | None, end: date | None) -> Column:
    """Inclusive bounds; an unknown date passes."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (taken >= F.lit(start))
    if end is not None:
        ok = ok & (taken <= F.lit(end))
    return taken.isNull() | ok


def has_camera(camera: Column, words: list[str]) -> Column:
    """Any keyword inside the camera's name; an unknown camera fails."""
    if not words:
        return F.lit(True)
    low = F.coalesce(F.lower(camera), F.lit(""))
    found = F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit(w))
    return (low != "") & found


def gps(latitude: Column, mode: str) -> Column:
    """``all``, ``with_gps`` or ``without_gps``."""
    return {"all": F.lit(True), "with_gps": latitude.isNotNull(), "without_gps": latitude.isNull()}[mode]


def big_enough(width: Column, height: Column, least_width: int, least_height: int) -> Column:
    """Known sizes must reach the least ones; 0 is unknown and passes."""
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    ok = F.lit(True)
    if least_width > 0:
        ok = ok & ~((w > 0) & (w < least_width))
    if least_height > 0:
        ok = ok & ~((h > 0) & (h < least_height))
    return ok


@dataclass(frozen=True)
class MetadataFilter:
    """Options of the pre-filter; the default lets everything pass."""

    start: date | None = None
    end: date | None = None
    cameras: list[str] = field(default_factory=list)
    gps: str = "all"
    least_width: int = 0
    least_height: int = 0

    def passes(self) -> Column:
        """Over columns taken_on, camera, latitude, width, height, readable.

        Unreadable metadata fails a camera filter and ``with_gps`` only.
        """
        readable = in_dates(F.col("taken_on"), self.start, self.end) & has_camera(F.col("camera"), self.cameras) & gps(F.col("latitude"), self.gps) & big_enough(F.col("width"), F.col("height"), self.least_width, self.least_height)
        unreadable = F.lit(not self.cameras and self.gps != "with_gps")
        return F.when(F.col("readable"), readable).otherwise(unreadable)

    def split(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(kept rows, one row with the kept and excluded counts)."""
        counts = files.agg(F.count_if(self.passes()).alias("kept"), F.count_if(~self.passes()).alias("excluded"))
        return files.where(self.passes()), counts
