"""Where intermediate tables live: the shared folder the cluster names.

``materialise`` writes a DataFrame as Parquet below ``spark.checkpoint.dir``
and reads it back.  That cuts the lineage, survives lost executors (the folder
is shared) and lets later jobs prune columns.  The write's shuffle files are
given up as soon as it ends, ``discard`` deletes tables that served their turn,
so the disk holds one step's files at a time.  A folder of its own is made only
on a local master that names none; a cluster must name one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only on a local master without any."""
    where = spark.conf.get(CHECKPOINT_KEY, None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="kindred-")
        spark.conf.set(CHECKPOINT_KEY, where)
    return where.rstrip("/")


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go at the end of each action inside."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kindred/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned and nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        for path in {os.path.dirname(f) for f in table.inputFiles()}:
            if "/kindred/" in path:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
