"""JSON-lines logs and JSON settings."""

from __future__ import annotations

import copy
import json

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

NOTIFICATION = "id string, timestamp timestamp, level string, category string, title string, message string, details string"

# Default settings.
DEFAULTS = {
    "scan": {"preset": "balanced", "batchSize": 100, "enableExifFilter": False, "enableIncremental": True, "exifMinWidth": 0, "exifMinHeight": 0, "exifGpsFilter": "all"},
    "ui": {"language": "ko", "theme": "auto", "use24HourClock": True, "notifyOnComplete": True, "minimizeToTray": True, "restoreWindowSize": True},
    "data": {"trashRetentionDays": 30, "autoCacheCleanup": True, "useSystemTrash": True},
}


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a folder of JSON-lines files; malformed lines are skipped."""
    return spark.read.schema(NOTIFICATION).option("mode", "DROPMALFORMED").json(path)


def recent_entries(log: DataFrame, limit: int) -> DataFrame:
    return log.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def append_entries(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def load_settings(text: str | None) -> dict[str, dict]:
    """Each section over its defaults; a corrupt document gives the defaults."""
    try:
        given = json.loads(text or "{}")
        return {s: {**d, **given.get(s, {})} for s, d in DEFAULTS.items()}
    except (ValueError, TypeError, AttributeError):
        return copy.deepcopy(DEFAULTS)


def save_settings(now: dict[str, dict], section: str, changes: dict) -> dict[str, dict]:
    """Merge into one section; an unknown section is an error."""
    if section not in DEFAULTS:
        raise KeyError(section)
    return {**now, section: {**now[section], **changes}}


def reset_settings(now: dict[str, dict], section: str) -> dict[str, dict]:
    return save_settings({**now, section: {}}, section, copy.deepcopy(DEFAULTS[section]))
