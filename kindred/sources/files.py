"""Image listings, directory sizes and folder validation.

Listings use Spark's ``binaryFile`` source without its content, so only paths
and sizes are read.  That source hides names starting with ``.`` or ``_``
and empty files.
"""

from __future__ import annotations

import os
import re
from pathlib import Path
from urllib.parse import unquote

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from kindred.functions.text import basename, dirname, extension

# The extensions of images.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".tiff", ".tif", ".bmp", ".gif", ".heic", ".heif")
EMPTY = "path string, modificationTime timestamp, length long"


def _listing(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    if "://" not in folder:
        if not os.path.isdir(folder):
            return spark.createDataFrame([], EMPTY)
        folder = Path(os.path.abspath(folder)).as_uri()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
    if recursive:
        return rows
    # A folder's own files have as many path parts more as it has itself; the scheme's slashes differ between the two.
    own = re.sub(r"^(\w+):/+", r"\1:/", folder).rstrip("/")
    return rows.where(F.url_decode(dirname(F.regexp_replace("path", r"^(\w+):/+", "$1:/"))) == unquote(own))


def list_images(spark: SparkSession, folders: list[tuple[str, bool]]) -> DataFrame:
    """path, modified, size, dir, filename, ext of all images in (folder, recursive) pairs.

    Missing folders are skipped; folders that overlap give a file twice.
    """
    rows = spark.createDataFrame([], EMPTY)
    for folder, recursive in folders:
        rows = rows.unionByName(_listing(spark, folder, recursive))
    path = F.col("path")
    out = rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), dirname(path).alias("dir"), basename(path).alias("filename"), extension(path).alias("ext"))
    return out.where(F.col("ext").isin(*EXTENSIONS))


def directory_size(spark: SparkSession, folder: str) -> DataFrame:
    """One row: files and bytes below a folder."""
    return _listing(spark, folder, True).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def validate_folder(path: str) -> dict[str, str | bool | None]:
    """{valid, path, reason}: whether a local folder exists, is one and can be read."""
    reason = None if os.path.isdir(path) and os.access(path, os.R_OK) else "not found" if not os.path.exists(path) else "not a folder" if not os.path.isdir(path) else "not readable"
    return {"valid": reason is None, "path": path, "reason": reason}


def image_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Images as they arrive, as a stream (an extra: the batch listing is the parity source)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return rows.where(extension(F.col("path")).isin(*EXTENSIONS)).select("path", "modificationTime", "length")
