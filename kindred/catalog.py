"""The review store's tables, bound to the driver's star schema.

A customer is a group of near-duplicates, an order one of its photos, the
lineitems of an order its trash history.  All columns are derived, so
the tables are scans with projections that prune and push down.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

RETENTION_DAYS = 30
TRASH_STATUS = {"N": "trashed", "R": "restored", "A": "purged"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, group_id, filename, file_size, quality, taken_at, is_master."""
    size = F.floor("o_totalprice").cast("long")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("group_id"),
        F.concat_ws("", F.lower("o_orderpriority"), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("filename"),
        size.alias("file_size"),
        (size % 101).alias("quality"),
        F.col("o_orderdate").alias("taken_at"),
    )
    best = Window.partitionBy("group_id").orderBy(F.desc("quality"), "id")
    return rows.withColumn("is_master", F.row_number().over(best) == 1)


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file_count, total_size, reclaimable_size, master_id, review_status, decision."""
    rolled = rollup(photos(spark, sf_dir))
    state = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 3 == 0, "pending").otherwise("reviewed").alias("review_status"),
        F.when(F.col("c_custkey") % 4 == 0, "kept_all").when(F.col("c_custkey") % 4 == 1, "duplicates_deleted").alias("decision"),
    )
    return rolled.join(state, "id")


def rollup(members: DataFrame) -> DataFrame:
    """Counts and sizes of each group; what its master does not need is reclaimable."""
    return members.groupBy(F.col("group_id").alias("id")).agg(
        F.count("*").alias("file_count"),
        F.sum("file_size").alias("total_size"),
        (F.sum("file_size") - F.max(F.when(F.col("is_master"), F.col("file_size")))).alias("reclaimable_size"),
        F.max(F.when(F.col("is_master"), F.col("id"))).alias("master_id"),
    )


def trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_id, file_size, status, deleted_at, expires_at; a photo may have several rows."""
    status = F.when(F.col("l_returnflag") == "N", "trashed").when(F.col("l_returnflag") == "R", "restored").otherwise("purged")
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("trash_id"),
            F.col("l_orderkey").alias("photo_id"),
            F.floor("l_extendedprice").cast("long").alias("size"),
            status.alias("status"),
            F.col("l_shipdate").alias("deleted_at"),
            (F.col("l_shipdate") + F.expr(f"INTERVAL {RETENTION_DAYS} DAYS")).alias("expires_at"),
        )
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, status, started_at of the scan history."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("started_at"))


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, category, user_id, details of the notification log."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("category"), "user_id", F.col("props").alias("details"))


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, camera, taken_at, latitude, width, height, readable: metadata before a scan."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "lang", "source", "n_chars").join(labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic")), "doc_id", "left")
    day = F.make_date(F.lit(2020), F.lit(1), F.lit(1)) + (F.col("doc_id") % 1000).cast("int")
    return rows.select(
        F.col("doc_id").alias("seq"),
        F.when(F.col("quality") == 0, None).otherwise(F.concat_ws(" ", F.col("lang"), F.initcap("source"))).alias("camera"),
        F.when(F.col("doc_id") % 7 != 0, day).alias("taken_on"),
        F.when(F.col("toxic").isNotNull(), F.col("doc_id") % 90).alias("latitude"),
        F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.col("n_chars") % 4000).cast("long").alias("width"),
        (F.col("n_chars") % 3000).alias("height"),
        (F.col("doc_id") % 11 != 0).alias("readable"),
    )


PHOTOS_SQL = """
photos AS (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY quality DESC, id) = 1 AS is_master FROM (
    SELECT o_orderkey AS id, o_custkey AS group_id,
           lower(o_orderpriority) || '_' || o_orderkey || '.jpg' AS filename,
           floor(o_totalprice)::BIGINT AS file_size, floor(o_totalprice)::BIGINT % 101 AS quality, o_orderdate AS taken_at
    FROM orders) x)"""
GROUPS_SQL = (
    PHOTOS_SQL
    + """,
groups AS (
  SELECT g.*, CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'reviewed' END AS review_status,
         CASE c_custkey % 4 WHEN 0 THEN 'kept_all' WHEN 1 THEN 'duplicates_deleted' END AS decision
  FROM (SELECT group_id AS id, count(*) AS file_count, sum(file_size)::BIGINT AS total_size,
               (sum(file_size) - max(file_size) FILTER (is_master))::BIGINT AS reclaimable_size,
               max(id) FILTER (is_master) AS master_id
        FROM photos GROUP BY group_id) g JOIN customer ON c_custkey = g.id)"""
)
TRASH_SQL = """
trash AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS trash_id, l_orderkey AS photo_id,
         floor(l_extendedprice)::BIGINT AS size,
         CASE l_returnflag WHEN 'N' THEN 'trashed' WHEN 'R' THEN 'restored' ELSE 'purged' END AS status,
         l_shipdate AS deleted_at, l_shipdate + INTERVAL 30 DAY AS expires_at
  FROM lineitem)"""
MEDIA_SQL = """
media AS (
  SELECT d.doc_id AS seq,
         CASE WHEN quality = 0 THEN NULL ELSE concat_ws(' ', lang, upper(source[1:1]) || lower(source[2:])) END AS camera,
         CASE WHEN d.doc_id % 7 <> 0 THEN DATE '2020-01-01' + (d.doc_id % 1000)::INT END AS taken_on,
         CASE WHEN toxic IS NOT NULL THEN d.doc_id % 90 END AS latitude,
         CASE WHEN d.doc_id % 5 = 0 THEN 0 ELSE n_chars % 4000 END AS width,
         n_chars % 3000 AS height, d.doc_id % 11 <> 0 AS readable
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
