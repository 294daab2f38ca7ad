"""Pages at any depth from a range-partitioned order.

``build`` sorts a table once: Spark deals it into ranges of the order, each range
is sorted and stored in a folder of its own, and the ranges' row counts (one
number a range) stay with the index.  A page adds up counts to find the one
or two ranges that hold it and reads only those, so the last page costs what the
first one does, and the total number of rows is known without a scan.

The order must be total: its last column tells all rows apart.  Nulls come first
in ascending and last in descending columns, as in Spark's own sort.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import accumulate

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from kindred.storage import shared_dir

RANGE_ROWS = 100_000


@dataclass(frozen=True)
class OrderIndex:
    spark: SparkSession
    path: str
    schema: str
    order: tuple[Column, ...]
    counts: tuple[int, ...]  # rows of each range, in order

    @property
    def total(self) -> int:
        return sum(self.counts)

    def ranges(self, offset: int, limit: int) -> tuple[list[int], int]:
        """The ranges that hold rows ``offset`` to ``offset + limit``, and the rows before the first of them."""
        ends = list(accumulate(self.counts))
        hit = [k for k, end in enumerate(ends) if end > offset and end - self.counts[k] < offset + limit and self.counts[k]]
        return hit, ends[hit[0]] - self.counts[hit[0]] if hit else 0

    def page(self, offset: int, limit: int) -> DataFrame:
        """The rows of a page in order, from its ranges alone."""
        hit, before = self.ranges(offset, limit)
        if not hit or limit <= 0:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/_range={k}" for k in hit))
        return rows.orderBy(*self.order).offset(offset - before).limit(limit)


def build(rows: DataFrame, order: list[Column], *, ranges: int | None = None, range_rows: int = RANGE_ROWS) -> OrderIndex:
    """Store ``rows`` in ``order``; by default in ranges of about ``range_rows``."""
    spark = rows.sparkSession
    ranges = ranges or max(1, -(-rows.count() // range_rows))
    path = f"{shared_dir(spark)}/kindred/order-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    dealt.sortWithinPartitions("_range", *order).write.partitionBy("_range").parquet(path)
    stored = spark.read.schema(f"{_ddl(rows)}, _range int").parquet(path)
    found = {r["_range"]: r["n"] for r in stored.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    counts = tuple(found.get(k, 0) for k in range(max(found, default=-1) + 1))
    return OrderIndex(spark, path, _ddl(rows), tuple(order), counts)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
