"""Queries over stored tables: versions, kept aggregates, ordered pages; each with its SQL."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from kindred import catalog as C
from kindred.catalog import GROUPS_SQL, TRASH_SQL
from kindred.functions import text as T
from kindred.operators import pages, rollups, trigrams
from kindred.plans import commits, organize, review, trash
from kindred.plans import scan as scans
from kindred.queries.formats import _FILES, _PLAN, _files
from kindred.sources.store import Snapshot, Store

QUERIES, SQL = {}, {}
SCAN = 1
AT = "1998-01-01 00:00:00"


def query(sql: str):
    def add(function):
        QUERIES[function.__name__], SQL[function.__name__] = function, sql
        return function

    return add


def _history(spark, sf) -> Store:
    """A store with the review tables as its first version."""
    store = Store(spark)
    history = C.scans(spark, sf).withColumn("discovered_groups", F.lit(None).cast("bigint"))
    store.commit({"photos": C.photos(spark, sf), "groups": C.groups(spark, sf), "trash": C.trash(spark, sf), "scans": history})
    return store


SIZES = {"photos": "file_size", "groups": "total_size", "trash": "size", "scans": "discovered_groups"}


def _summary(snapshot: Snapshot) -> DataFrame:
    each = [snapshot.table(n).agg(F.count("*").alias("n"), F.coalesce(F.sum(c), F.lit(0)).alias("total")).select(F.lit(snapshot.version).alias("version"), F.lit(n).alias("name"), "n", "total") for n, c in SIZES.items()]
    return reduce(DataFrame.unionByName, each)


_BEFORE = """SELECT 1 AS version, 'photos' AS name, count(*) AS n, coalesce(sum(file_size), 0)::BIGINT AS total FROM photos
UNION ALL SELECT 1, 'groups', count(*), coalesce(sum(total_size), 0)::BIGINT FROM groups
UNION ALL SELECT 1, 'trash', count(*), coalesce(sum(size), 0)::BIGINT FROM trash
UNION ALL SELECT 1, 'scans', count(*), 0 FROM orders"""


@query(f"""WITH {GROUPS_SQL}, {TRASH_SQL}, {_BEFORE.replace("SELECT 1 AS version", "before AS (SELECT 1 AS version", 1)})
SELECT * FROM before UNION ALL SELECT 2, 'photos', count(*), coalesce(sum(file_size), 0)::BIGINT FROM photos WHERE id % 3 <> 0
UNION ALL SELECT 2, 'groups', count(DISTINCT group_id), coalesce(sum(file_size), 0)::BIGINT FROM photos WHERE id % 3 <> 0
UNION ALL SELECT 2, 'trash', 0, 0
UNION ALL SELECT 2, 'scans', (SELECT count(*) FROM orders), CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey = {SCAN}) THEN count(DISTINCT group_id) ELSE 0 END FROM photos WHERE id % 3 <> 0""")
def scan_commit_snapshots(spark, sf):
    """A new scan replaces four tables at once; the version before can still be read."""
    store = _history(spark, sf)
    old = store.snapshot()
    kept = old.table("photos").where("id % 3 <> 0")
    best = Window.partitionBy("group_id").orderBy(F.desc("quality"), "id")
    members = kept.select("group_id", F.col("id").alias("member"), "quality").withColumn("is_master", F.row_number().over(best.orderBy(F.desc("quality"), "member")) == 1)
    groups, photos = scans.scan_result(members, kept.select(F.col("id").alias("seq"), F.col("filename").alias("path"), "file_size"))
    new = commits.save_scan(store, SCAN, groups, photos)
    return _summary(old).unionByName(_summary(new))


@query(f"WITH {GROUPS_SQL}, {TRASH_SQL}, {_BEFORE.replace('SELECT 1 AS version', 'before AS (SELECT 1 AS version', 1)}) SELECT * FROM before UNION ALL SELECT 2, name, 0, 0 FROM before")
def clear_scan_history(spark, sf):
    store = _history(spark, sf)
    old = store.snapshot()
    return _summary(old).unionByName(_summary(commits.clear_scan_history(store)))


@query(f"""WITH {_FILES}, even AS (SELECT * FROM files WHERE seq % 2 = 0), odd AS (SELECT * FROM files WHERE seq % 2 = 1),
p AS (SELECT 1 AS job_id, * FROM ({_PLAN.replace('FROM files', 'FROM even')}) a UNION ALL SELECT 2, * FROM ({_PLAN.replace('FROM files', 'FROM odd')}) b)
SELECT job_id, CASE job_id WHEN 1 THEN 'undone' ELSE 'completed' END AS status, count(*) OVER (PARTITION BY job_id) AS renamed, CASE job_id WHEN 1 THEN TIMESTAMP '{AT}' END AS undone_at, original_path, renamed_path FROM p""")
def rename_job_log(spark, sf):
    """Two jobs are added to the log, then the first is undone."""
    store, at = Store(spark), F.lit(AT).cast("timestamp_ntz")
    for job, rest in ((1, 0), (2, 1)):
        files = _files(spark, sf).where(F.col("seq") % 2 == rest)
        commits.save_rename_job(store, job, organize.rename_plan(files), files.count(), at)
    done = commits.undo_rename_job(store, 1, at)
    jobs = done.table("rename_jobs").select(F.col("id").alias("job_id"), "status", "renamed", "undone_at")
    return done.table("renames").join(jobs, "job_id")


_KEPT = "SELECT {k} AS step, count(*) AS total_files, coalesce(sum(size), 0)::BIGINT AS total_size, min(expires_at) AS next_cleanup FROM trash WHERE status = 'trashed'{where}"
_LEFT = f" AND NOT (expires_at < TIMESTAMP '{AT}')"


@query(f"""WITH {GROUPS_SQL}, {TRASH_SQL}, {{}}
fresh AS (SELECT file_size AS size, TIMESTAMP '{AT}' + INTERVAL 30 DAY AS expires_at FROM photos WHERE NOT is_master AND id NOT IN (SELECT photo_id FROM trash WHERE status = 'trashed' AND NOT (expires_at < TIMESTAMP '{AT}') AND photo_id % 3 <> 0))
{_KEPT.format(k=0, where="")} UNION ALL {_KEPT.format(k=1, where=_LEFT)} UNION ALL {_KEPT.format(k=2, where=_LEFT + " AND photo_id % 3 <> 0")}
UNION ALL SELECT 3, count(*), coalesce(sum(size), 0)::BIGINT, min(expires_at) FROM (SELECT size, expires_at FROM trash WHERE status = 'trashed'{_LEFT} AND photo_id % 3 <> 0 UNION ALL SELECT size, expires_at FROM fresh) z""".replace("{}", ""))
def trash_summary_kept(spark, sf):
    """The trash summary from its stored aggregate, after purging, restoring and deleting; no step reads the whole trash for it."""
    store, at = Store(spark), F.lit(AT).cast("timestamp_ntz")
    rows = C.trash(spark, sf).select("photo_id", "size", "status", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))
    store.commit({"trash": rows, "kept": rollups.TRASH.build(rows)})
    shots = [store.snapshot()]
    held = F.col("status") == "trashed"
    for which, status in ((held & (F.col("expires_at") < at), "purged"), (held & (F.col("photo_id") % 3 == 0), "restored")):
        now = shots[-1]
        gone, come = rollups.changed(now.table("trash"), which, status=F.lit(status))
        after = now.table("trash").withColumn("status", F.when(which, status).otherwise(F.col("status")))
        shots.append(store.commit({"trash": after, "kept": rollups.TRASH.fold(now.table("kept"), gone, come)}, base=now))
    now = shots[-1]
    fresh = trash.move_to_trash(C.photos(spark, sf), now.table("trash"), ~F.col("is_master"), at).select(*rows.columns)
    shots.append(store.commit({"kept": rollups.TRASH.fold(now.table("kept"), added=fresh)}, {"trash": fresh}, base=now))
    return reduce(DataFrame.unionByName, (rollups.trash_summary(s.table("kept")).withColumn("step", F.lit(k)) for k, s in enumerate(shots)))


_REVIEW = "SELECT {k} AS step, count(*) AS total_groups, coalesce(sum(file_count), 0)::BIGINT AS total_photos, coalesce(sum(reclaimable_size), 0)::BIGINT AS reclaimable_size, count(*) FILTER ({p}) AS pending_groups, coalesce(sum(reclaimable_size) FILTER ({p}), 0)::BIGINT AS pending_size FROM groups"


@query(f"""WITH {GROUPS_SQL} {_REVIEW.format(k=0, p="review_status = 'pending'")} UNION ALL {_REVIEW.format(k=1, p="review_status = 'pending' AND id % 2 = 1")}""")
def review_summary_kept(spark, sf):
    """Statistics of all and of undecided groups, kept while half of the groups are marked."""
    groups = C.groups(spark, sf)
    which = F.col("id") % 2 == 0
    before = rollups.GROUPS.build(groups)
    after = rollups.GROUPS.fold(before, groups.where(which), review.mark_reviewed(groups.where(which), F.lit(True), "kept_all", F.lit(AT).cast("timestamp_ntz")))
    return rollups.review_summary(before).withColumn("step", F.lit(0)).unionByName(rollups.review_summary(after).withColumn("step", F.lit(1)))


@query(f"""WITH {TRASH_SQL}, held AS (SELECT * FROM trash WHERE status = 'trashed'), placed AS (SELECT *, row_number() OVER (ORDER BY deleted_at DESC, trash_id, size) AS k, count(*) OVER () AS total FROM held)
SELECT * EXCLUDE (k) FROM placed WHERE k > total // 2 AND k <= total // 2 + 50""")
def trash_page_deep(spark, sf):
    """The page in the middle of the trash, from an order index; the limit is the feature."""
    held = C.trash(spark, sf).where(F.col("status") == "trashed")
    index = pages.build(held, [F.desc("deleted_at"), F.asc("trash_id"), F.asc("size")], range_rows=5000)
    return index.page(index.total // 2, 50).withColumn("total", F.lit(index.total).cast("bigint"))


@query("SELECT o_orderkey AS id, lower(o_orderpriority) || '_' || o_orderkey || '.jpg' AS text FROM orders WHERE lower(o_orderpriority) || '_' || o_orderkey || '.jpg' ILIKE '%URGENT_1%23%'")
def photo_search_indexed(spark, sf):
    """Photos by part of their name, candidates from the trigram index."""
    return trigrams.build(C.photos(spark, sf).select("id", F.col("filename").alias("text"))).search("%URGENT_1%23%")


_MOVES = (("paused", 2), ("running", 3), ("completed", 5), ("failed", 7), ("cancelled", 11))


def _moves_sql() -> str:
    state, ended, error = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END", "NULL::TIMESTAMP", "NULL::VARCHAR"
    parts = [f"s0 AS (SELECT o_orderkey AS id, {state} AS status FROM orders)"]
    out = []
    for k, (status, each) in enumerate(_MOVES):
        allowed = ", ".join(f"'{x}'" for x in scans.FOLLOWS[status])
        hit = f"id % {each} = 0 AND status IN ({allowed})"
        ends = status in ("completed", "failed", "cancelled")
        parts.append(f"t{k} AS (SELECT id, CASE WHEN {hit} THEN '{status}' ELSE status END AS status, CASE WHEN {hit} AND {ends} THEN TIMESTAMP '{AT}' END AS ended_at, CASE WHEN {hit} AND {status == 'failed'} THEN 'lost' END AS error_message FROM s{k}), s{k + 1} AS (SELECT id, status FROM t{k})")
        out.append(f"SELECT {k} AS step, status, count(*) AS n, count(ended_at) AS ended, count(error_message) AS errors FROM t{k} GROUP BY status")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


@query(_moves_sql())
def scan_state_moves(spark, sf):
    """All moves between the states of a scan, one after the other: how many scans are where after each."""
    now, out = C.scans(spark, sf).select("id", "status"), []
    for k, (status, each) in enumerate(_MOVES):
        after = scans.set_status(now, F.col("id") % each == 0, status, F.lit(AT).cast("timestamp_ntz"), "lost")
        out.append(after.groupBy("status").agg(F.count("*").alias("n"), F.count("ended_at").alias("ended"), F.count("error_message").alias("errors")).withColumn("step", F.lit(k)))
        now = after.select("id", "status")
    return reduce(DataFrame.unionByName, out)


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'custom' WHEN 1 THEN 'conservative' ELSE CASE o_orderkey % 2 WHEN 0 THEN 'fast' ELSE 'custom' END END AS preset FROM orders")
def scan_config_presets(spark, sf):
    """Which preset each stored scan was run with, from its JSON settings."""
    config = """{"hash_algorithms": ["%s"], "hash_thresholds": {"%s": %d}, "merge_strategy": "union", "verify_algorithms": ["ssim"], "verify_thresholds": {"ssim": %s}}"""
    key = F.col("o_orderkey")
    fast = F.when(key % 2 == 0, config % ("dhash", "dhash", 8, 0.75)).otherwise(config % ("dhash", "dhash", 8, 0.76))
    stored = F.when(key % 3 == 0, F.when(key % 2 == 0, "{}").otherwise("not json")).when(key % 3 == 1, config % ("phash", "phash", 6, 0.85)).otherwise(fast)
    return C.table(spark, sf, "orders").select(key.alias("id"), scans.config_presets(stored).alias("preset"))


@query("SELECT event_id AS id, strftime(ts, '%b %-d %H:%M') AS compact, strftime(ts, '%b %-d %I:%M %p') AS compact_12 FROM events")
def format_compact_dates(spark, sf):
    return C.table(spark, sf, "events").select(F.col("event_id").alias("id"), T.format_date_compact(F.col("ts")).alias("compact"), T.format_date_compact(F.col("ts"), False).alias("compact_12"))
