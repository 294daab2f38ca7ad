"""Queries over the review store, each with its SQL."""

from __future__ import annotations

from datetime import date

import pyspark.sql.functions as F

from kindred import catalog as C
from kindred.catalog import GROUPS_SQL, MEDIA_SQL, PHOTOS_SQL, TRASH_SQL
from kindred.operators.filters import MetadataFilter, keywords
from kindred.plans import review, stats, trash
from kindred.plans import scan as scans

QUERIES, SQL = {}, {}
NOW = "1998-01-01 00:00:00"


def query(sql: str):
    """Register a query under its function's name."""

    def add(function):
        QUERIES[function.__name__], SQL[function.__name__] = function, sql
        return function

    return add


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(f"WITH {GROUPS_SQL} SELECT id, file_count, total_size, reclaimable_size, master_id FROM groups")
def group_rollup(spark, sf):
    return C.groups(spark, sf).select("id", "file_count", "total_size", "reclaimable_size", "master_id")


@query(f"WITH {PHOTOS_SQL} SELECT group_id, id, quality FROM photos WHERE is_master")
def master_selection(spark, sf):
    return C.photos(spark, sf).where("is_master").select("group_id", "id", "quality")


@query(f"WITH {PHOTOS_SQL} SELECT group_id, id AS photo_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY quality DESC, id) AS k FROM photos WHERE NOT is_master) x WHERE k = 1")
def best_duplicate(spark, sf):
    return review.best_duplicate(C.photos(spark, sf))


_PAGE = """SELECT g.id, file_count, total_size, reclaimable_size, review_status, decision,
  EXISTS (SELECT 1 FROM photos p JOIN trash t ON t.photo_id = p.id WHERE p.group_id = g.id AND t.status = 'purged') AS has_purged,
  coalesce((SELECT filename FROM photos m WHERE m.id = g.master_id), '') AS master_filename, g.total
FROM (SELECT *, count(*) OVER () AS total FROM groups WHERE {where}) g ORDER BY g.id {page}"""
_LISTS = f"WITH {GROUPS_SQL}, {TRASH_SQL} "


def _groups(spark, sf, **options):
    return review.list_groups(C.groups(spark, sf), C.photos(spark, sf), C.trash(spark, sf), **options)


@query(_LISTS + _PAGE.format(where="true", page="LIMIT 50 OFFSET 100"))
def group_list_page(spark, sf):
    """A page: the limit is the feature."""
    return _groups(spark, sf, offset=100, limit=50)


@query(_LISTS + _PAGE.format(where="id IN (SELECT group_id FROM photos WHERE filename ILIKE '%URGENT_1%')", page=""))
def group_list_search(spark, sf):
    return _groups(spark, sf, search="URGENT_1", limit=None)


@query(_LISTS + _PAGE.format(where="review_status = 'pending'", page=""))
def group_list_status(spark, sf):
    return _groups(spark, sf, status="pending", limit=None)


@query(f"WITH {PHOTOS_SQL}, {TRASH_SQL} SELECT DISTINCT group_id AS id FROM photos p JOIN trash t ON t.photo_id = p.id WHERE t.status = 'purged'")
def group_has_purged(spark, sf):
    return review.has_purged(C.photos(spark, sf), C.trash(spark, sf))


@query(f"WITH {PHOTOS_SQL}, {TRASH_SQL} SELECT group_id, p.id, filename, file_size, quality, is_master, trash_id, t.status AS trash_status, row_number() OVER (PARTITION BY group_id ORDER BY quality DESC, p.id, trash_id) AS place FROM photos p LEFT JOIN trash t ON t.photo_id = p.id")
def group_detail_left_join(spark, sf):
    return review.group_detail(C.photos(spark, sf), C.trash(spark, sf))


@query(f"WITH {GROUPS_SQL}, {TRASH_SQL} SELECT p.id AS photo_id, filename, p.file_size, group_id FROM photos p JOIN groups g ON g.id = p.group_id LEFT JOIN trash t ON t.photo_id = p.id WHERE g.decision = 'duplicates_deleted' AND NOT p.is_master AND (t.trash_id IS NULL OR t.status = 'restored')")
def pending_deletions(spark, sf):
    return review.pending_deletions(C.photos(spark, sf), C.groups(spark, sf), C.trash(spark, sf))


@query(f"WITH {GROUPS_SQL}, {TRASH_SQL} SELECT count(*) AS photos, coalesce(sum(file_size), 0)::BIGINT AS bytes FROM photos p WHERE NOT is_master AND group_id IN (SELECT id FROM groups WHERE decision = 'duplicates_deleted') AND (id NOT IN (SELECT photo_id FROM trash) OR id IN (SELECT photo_id FROM trash WHERE status = 'restored'))")
def pending_deletion_size(spark, sf):
    return review.pending_size(review.pending_deletions(C.photos(spark, sf), C.groups(spark, sf), C.trash(spark, sf)))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS status, CASE WHEN o_orderstatus = 'O' THEN TIMESTAMP '" + NOW + "' END AS ended_at, CASE WHEN o_orderstatus = 'O' THEN 'disk full' END AS error_message FROM orders")
def scan_failures(spark, sf):
    """Every running scan fails; ended ones stay as they are."""
    return scans.set_status(C.scans(spark, sf), F.lit(True), "failed", now(), "disk full").select("id", "status", "ended_at", "error_message")


@query("WITH q AS (SELECT o_orderkey AS id, o_custkey AS group_id, floor(o_totalprice)::BIGINT AS file_size, floor(o_totalprice)::BIGINT % 101 AS quality FROM orders), m AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY quality DESC, id) = 1 AS is_master FROM q) SELECT group_id AS id, count(*) AS file_count, sum(file_size)::BIGINT AS total_size, (sum(file_size) - max(file_size) FILTER (is_master))::BIGINT AS reclaimable_size, max(id) FILTER (is_master) AS master_id, 'pending' AS review_status, CAST(NULL AS VARCHAR) AS decision FROM m GROUP BY group_id")
def scan_result_groups(spark, sf):
    """What a scan stores: all groups undecided again."""
    photos = C.photos(spark, sf)
    members = photos.select("group_id", F.col("id").alias("member"), "quality", "is_master")
    return scans.scan_result(members, photos.select(F.col("id").alias("seq"), F.col("filename").alias("path"), "file_size"))[0]


_CHOSEN = "chosen AS (SELECT group_id, min(id) AS photo_id FROM photos GROUP BY group_id)"


def _chosen(spark, sf):
    return C.photos(spark, sf).groupBy("group_id").agg(F.min("id").alias("photo_id"))


@query(f"WITH {GROUPS_SQL}, {_CHOSEN} SELECT g.id, c.photo_id AS master_id, g.total_size, g.total_size - p.file_size AS reclaimable_size FROM groups g JOIN chosen c ON c.group_id = g.id JOIN photos p ON p.id = c.photo_id")
def change_master(spark, sf):
    _, after = review.change_master(C.photos(spark, sf), C.groups(spark, sf), _chosen(spark, sf))
    return after.select("id", "master_id", "total_size", "reclaimable_size")


@query(f"WITH {PHOTOS_SQL}, {_CHOSEN} SELECT p.id, p.group_id, p.id = c.photo_id AS is_master FROM photos p JOIN chosen c ON c.group_id = p.group_id")
def change_master_flags(spark, sf):
    after, _ = review.change_master(C.photos(spark, sf), C.groups(spark, sf), _chosen(spark, sf))
    return after.select("id", "group_id", "is_master")


@query(f"WITH {GROUPS_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN 'reviewed' ELSE review_status END AS review_status, CASE WHEN id % 2 = 0 THEN NULL ELSE decision END AS decision, CASE WHEN id % 2 = 0 THEN TIMESTAMP '{NOW}' END AS reviewed_at, CAST(NULL AS TIMESTAMP) AS decided_at FROM groups")
def mark_reviewed_clears(spark, sf):
    return review.mark_reviewed(C.groups(spark, sf), F.col("id") % 2 == 0, None, now()).select("id", "review_status", "decision", "reviewed_at", "decided_at")


@query(f"WITH {GROUPS_SQL} SELECT id, 'reviewed' AS review_status, 'kept_all' AS decision, TIMESTAMP '{NOW}' AS reviewed_at, TIMESTAMP '{NOW}' AS decided_at FROM groups")
def mark_reviewed(spark, sf):
    return review.mark_reviewed(C.groups(spark, sf), F.lit(True), "kept_all", now()).select("id", "review_status", "decision", "reviewed_at", "decided_at")


@query(f"WITH {TRASH_SQL} SELECT *, (SELECT count(*) FROM trash WHERE status = 'trashed') AS total FROM trash WHERE status = 'trashed' ORDER BY deleted_at DESC, trash_id, size LIMIT 50 OFFSET 20")
def trash_list_page(spark, sf):
    """A page: the limit is the feature."""
    return trash.trash_page(C.trash(spark, sf), offset=20, limit=50)


@query(f"WITH {TRASH_SQL} SELECT count(*) AS total_files, coalesce(sum(size), 0)::BIGINT AS total_size, min(expires_at) AS next_cleanup FROM trash WHERE status = 'trashed'")
def trash_summary(spark, sf):
    return trash.trash_summary(C.trash(spark, sf))


@query(f"WITH {TRASH_SQL} SELECT trash_id, size, expires_at FROM trash WHERE status = 'trashed' AND expires_at < TIMESTAMP '{NOW}'")
def trash_expired(spark, sf):
    return trash.expired(C.trash(spark, sf), now()).select("trash_id", "size", "expires_at")


@query(f"WITH {TRASH_SQL} SELECT trash_id, size, CASE WHEN status = 'trashed' AND expires_at < TIMESTAMP '{NOW}' THEN 'purged' ELSE status END AS status FROM trash")
def trash_purge_expired(spark, sf):
    return trash.purge(C.trash(spark, sf), F.col("expires_at") < now()).select("trash_id", "size", "status")


@query(f"WITH {TRASH_SQL} SELECT trash_id, size, CASE WHEN status = 'trashed' AND photo_id % 3 = 0 THEN 'restored' ELSE status END AS status, CASE WHEN status = 'trashed' AND photo_id % 3 = 0 THEN TIMESTAMP '{NOW}' END AS restored_at FROM trash")
def trash_restore(spark, sf):
    return trash.restore(C.trash(spark, sf), F.col("photo_id") % 3 == 0, now()).select("trash_id", "size", "status", "restored_at")


@query(f"WITH {PHOTOS_SQL}, {TRASH_SQL} SELECT group_id, photo_id, trash_id, filename, size FROM trash t JOIN photos p ON p.id = t.photo_id WHERE status = 'trashed'")
def restore_group_candidates(spark, sf):
    return trash.restorable(C.trash(spark, sf), C.photos(spark, sf))


@query(f"WITH {PHOTOS_SQL}, {TRASH_SQL} SELECT id AS photo_id, filename, file_size AS size, 'trashed' AS status, TIMESTAMP '{NOW}' AS deleted_at, TIMESTAMP '{NOW}' + INTERVAL 30 DAY AS expires_at FROM photos p WHERE NOT is_master AND id NOT IN (SELECT photo_id FROM trash WHERE status = 'trashed')")
def move_to_trash(spark, sf):
    return trash.move_to_trash(C.photos(spark, sf), C.trash(spark, sf), ~F.col("is_master"), now())


@query(f"WITH {GROUPS_SQL} SELECT (SELECT count(*) FROM photos) AS total_photos, count(*) AS total_groups, coalesce(sum(reclaimable_size), 0)::BIGINT AS reclaimable_size, (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS last_scan_id, (SELECT max(o_orderdate) FROM orders) AS last_scan_at FROM groups")
def dashboard_stats(spark, sf):
    return stats.dashboard(C.photos(spark, sf), C.groups(spark, sf), C.scans(spark, sf))


@query(f"WITH {GROUPS_SQL} SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS started_at, (SELECT count(*) FROM groups WHERE review_status = 'reviewed') AS reviewed_groups, (SELECT count(*) FROM groups) AS total_groups FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def scan_history_top10(spark, sf):
    """A top-10 report: the limit is the feature."""
    return stats.scan_history(C.scans(spark, sf), C.groups(spark, sf))


@query("SELECT o_orderstatus AS status, count(*) AS scans, ceil(count(*) / 50)::BIGINT AS pages FROM orders GROUP BY o_orderstatus")
def page_counts(spark, sf):
    rows = C.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("scans"))
    return rows.withColumn("pages", stats.page_count(F.col("scans"), 50))


@query(f"WITH {MEDIA_SQL} SELECT seq FROM media WHERE taken_on IS NULL OR (taken_on >= DATE '2020-06-01' AND taken_on <= DATE '2021-03-01')")
def filter_date_range(spark, sf):
    from kindred.operators.filters import in_dates

    return C.media(spark, sf).where(in_dates(F.col("taken_on"), date(2020, 6, 1), date(2021, 3, 1))).select("seq")


@query(f"WITH {MEDIA_SQL} SELECT seq, camera FROM media WHERE camera <> '' AND (contains(lower(camera), 'src1') OR contains(lower(camera), 'de src7'))")
def filter_camera_keywords(spark, sf):
    from kindred.operators.filters import has_camera

    return C.media(spark, sf).where(has_camera(F.col("camera"), keywords(" SRC1, ,de src7"))).select("seq", "camera")


@query(f"WITH {MEDIA_SQL} SELECT seq, latitude IS NOT NULL AS with_gps, latitude IS NULL AS without_gps FROM media")
def filter_gps_tristate(spark, sf):
    from kindred.operators.filters import gps

    return C.media(spark, sf).where(gps(F.col("latitude"), "all")).select("seq", gps(F.col("latitude"), "with_gps").alias("with_gps"), gps(F.col("latitude"), "without_gps").alias("without_gps"))


@query(f"WITH {MEDIA_SQL} SELECT seq, width, height FROM media WHERE NOT (width > 0 AND width < 1500) AND NOT (height > 0 AND height < 900)")
def filter_min_dims(spark, sf):
    from kindred.operators.filters import big_enough

    return C.media(spark, sf).where(big_enough(F.col("width"), F.col("height"), 1500, 900)).select("seq", "width", "height")


_COMBINED = "CASE WHEN readable THEN (taken_on IS NULL OR taken_on >= DATE '2020-03-01') AND coalesce(camera, '') <> '' AND contains(lower(coalesce(camera, '')), 'src') AND latitude IS NOT NULL AND NOT (width > 0 AND width < 800) ELSE false END"


@query(f"WITH {MEDIA_SQL} SELECT count(*) FILTER ({_COMBINED}) AS kept, count(*) FILTER (NOT {_COMBINED}) AS excluded FROM media")
def filter_combined_counts(spark, sf):
    chosen = MetadataFilter(start=date(2020, 3, 1), cameras=["src"], gps="with_gps", least_width=800)
    return chosen.split(C.media(spark, sf))[1]


@query(f"WITH {MEDIA_SQL} SELECT seq FROM media WHERE CASE WHEN readable THEN NOT (width > 0 AND width < 800) ELSE true END")
def filter_unreadable_metadata(spark, sf):
    return MetadataFilter(least_width=800).split(C.media(spark, sf))[0].select("seq")
