"""Formatting and path functions as Column builders; locale English, time UTC."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

DASH = "—"


def format_bytes(n: Column) -> Column:
    """1024-based with no decimals for whole values, else one."""
    out = F.lit("0 B")
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        value = n / float(1024**k)
        text = F.when(value % 1 == 0, F.format_string("%.0f", value)).otherwise(F.format_string("%.1f", value))
        out = F.when(n >= 1024**k, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out


def _number(x: Column) -> Column:
    return F.floor(x).cast("long").cast("string")


def format_time(seconds: Column) -> Column:
    m = F.floor(seconds / 60)
    short = F.concat(_number(seconds % 60), F.lit("s"))
    return F.when(seconds <= 0, DASH).when(m == 0, short).when(m < 60, F.concat(_number(m), F.lit("m "), short)).otherwise(F.concat(_number(m / 60), F.lit("h "), _number(m % 60), F.lit("m")))


def half_up(x: Column) -> Column:
    """Nearest whole number, halves up."""
    return F.floor(x + 0.5).cast("long")


def format_duration(seconds: Column) -> Column:
    m = F.floor(seconds / 60)
    return (
        F.when(seconds < 60, F.concat(half_up(seconds).cast("string"), F.lit("s")))
        .when(m < 60, F.concat(_number(m), F.lit("m "), half_up(seconds % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(_number(m / 60), F.lit("h "), _number(m % 60), F.lit("m")))
    )


def format_number(n: Column) -> Column:
    return F.format_number(n, 0)


def format_speed(files_a_second: Column) -> Column:
    return F.concat(F.format_number(half_up(files_a_second * 3600), 0), F.lit(" files/hour"))


def format_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy")


def format_date_time(ts: Column, hours_24: bool = True) -> Column:
    return F.coalesce(F.date_format(ts, "MMM d, yyyy, HH:mm" if hours_24 else "MMM d, yyyy, hh:mm a"), F.lit(DASH))


def format_date_compact(ts: Column, hours_24: bool = True) -> Column:
    """Day and time without the year."""
    return F.date_format(ts, "MMM d HH:mm" if hours_24 else "MMM d hh:mm a")


def relative_time(ts: Column, now: Column) -> Column:
    s = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1_000_000)
    step = lambda size, unit: F.concat(_number(s / size), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, step(60, "m")).when(s < 86400, step(3600, "h")).otherwise(step(86400, "d"))


def shutter(seconds: Column) -> Column:
    """``2s`` or ``1/250s``."""
    whole = F.when(seconds % 1 == 0, _number(seconds)).otherwise(seconds.cast("string"))
    return F.when(seconds >= 1, F.concat(whole, F.lit("s"))).when(seconds > 0, F.concat(F.lit("1/"), half_up(1 / seconds).cast("string"), F.lit("s")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty without one or for dot files."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def shorten(path: Column, most: int = 60) -> Column:
    half = most // 2
    return F.when(F.length(path) <= most, path).otherwise(F.concat(F.left(path, F.lit(half)), F.lit("…"), F.right(path, F.lit(half))))


def split_camel(key: Column) -> Column:
    """``FocalLength`` as ``Focal Length``."""
    return F.trim(F.regexp_replace(key, "([a-z])([A-Z])", "$1 $2"))


def thumbnail_size(width: Column, height: Column, most: int = 200) -> tuple[Column, Column]:
    """Fit inside a square without enlarging."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / width, F.lit(float(most)) / height)
    return F.greatest(F.lit(1), half_up(width * scale)), F.greatest(F.lit(1), half_up(height * scale))


# Metadata keys by section.
EXIF_SECTIONS = {
    "Camera": ["Make", "Model", "LensModel", "LensMake", "Software"],
    "Capture": ["DateTimeOriginal", "CreateDate", "ModifyDate", "ExposureTime", "FNumber", "ISO", "FocalLength", "FocalLengthIn35mmFormat", "ExposureProgram", "ExposureMode", "MeteringMode", "WhiteBalance", "Flash", "ExposureCompensation", "BrightnessValue"],
    "Image": ["ImageWidth", "ImageHeight", "ExifImageWidth", "ExifImageHeight", "Orientation", "ColorSpace", "BitsPerSample", "ComponentsConfiguration", "YCbCrPositioning", "ResolutionUnit", "XResolution", "YResolution"],
    "GPS": ["latitude", "longitude", "GPSAltitude", "GPSSpeed", "GPSImgDirection"],
}


def exif_section(key: Column) -> Column:
    out = F.lit("Other")
    for section, keys in EXIF_SECTIONS.items():
        out = F.when(key.isin(keys), section).otherwise(out)
    return out


def exif_value(key: Column, value: Column) -> Column:
    """A number's text by its key."""
    plain = F.when(value % 1 == 0, _number(value)).otherwise(value.cast("string"))
    return (
        F.when(value.isNull(), DASH)
        .when(key == "ExposureTime", shutter(value))
        .when(key == "FNumber", F.concat(F.lit("f/"), plain))
        .when(key.isin("FocalLength", "FocalLengthIn35mmFormat"), F.concat(plain, F.lit("mm")))
        .when(key.isin("latitude", "longitude"), F.format_string("%.6f", value))
        .otherwise(plain)
    )


def version_number(tag: Column) -> Column:
    return F.regexp_replace(tag, "^v", "")
