"""Queries of scalar functions, folders, renames, notifications and settings."""

from __future__ import annotations

import pyspark.sql.functions as F

from kindred.catalog import MEDIA_SQL, media, notifications, table
from kindred.functions import text as T
from kindred.plans import folders, organize, stats
from kindred.plans import notifications as notes
from kindred.plans import scan as scans

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


_UNIT = "CASE WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END"


@query(f"""WITH b AS (SELECT o_orderkey AS id, (floor(o_totalprice)::BIGINT - 900) * (o_orderkey % 3000) AS n FROM orders), u AS (SELECT *, {_UNIT} AS k, n / pow(1024, {_UNIT}) AS v FROM b WHERE n >= 0)
SELECT id, CASE WHEN n = 0 THEN '0 B' ELSE (CASE WHEN v % 1 = 0 THEN printf('%.0f', v) ELSE printf('%.1f', floor(v * 10 + 0.5) / 10) END) || ' ' || ['B', 'KB', 'MB', 'GB'][k + 1] END AS text FROM u""")
def format_bytes(spark, sf):
    n = (F.floor("o_totalprice").cast("long") - 900) * (F.col("o_orderkey") % 3000)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), n.alias("n")).where("n >= 0").select("id", T.format_bytes(F.col("n")).alias("text"))


@query("""WITH s AS (SELECT event_id AS id, value * 37 AS s FROM events)
SELECT id, CASE WHEN s < 60 THEN floor(s + 0.5)::BIGINT || 's' WHEN floor(s / 60) < 60 THEN floor(s / 60)::BIGINT || 'm ' || floor(s % 60 + 0.5)::BIGINT || 's' ELSE floor(floor(s / 60) / 60)::BIGINT || 'h ' || (floor(s / 60)::BIGINT % 60) || 'm' END AS duration,
 CASE WHEN s <= 0 THEN '—' WHEN floor(s / 60) = 0 THEN floor(s % 60)::BIGINT || 's' WHEN floor(s / 60) < 60 THEN floor(s / 60)::BIGINT || 'm ' || floor(s % 60)::BIGINT || 's' ELSE floor(floor(s / 60) / 60)::BIGINT || 'h ' || (floor(s / 60)::BIGINT % 60) || 'm' END AS time FROM s""")
def format_duration(spark, sf):
    s = F.col("value") * 37
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), T.format_duration(s).alias("duration"), T.format_time(s).alias("time"))


@query("SELECT event_id AS id, printf('%,d', floor(value * 3600 + 0.5)::BIGINT) || ' files/hour' AS speed, printf('%,d', event_id * 977) AS number FROM events".replace("printf('%,d', ", "format('{:,}', "))
def format_speed(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), T.format_speed(F.col("value")).alias("speed"), T.format_number(F.col("event_id") * 977).alias("number"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%b %-d, %Y') AS day, strftime(o_orderdate + to_minutes((o_orderkey % 1440)::INT), '%b %-d, %Y, %H:%M') AS moment FROM orders")
def format_dates(spark, sf):
    moment = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.format_date(F.col("o_orderdate")).alias("day"), T.format_date_time(moment).alias("moment"))


@query("""WITH s AS (SELECT event_id AS id, floor(epoch(TIMESTAMP '2024-02-01' - ts))::BIGINT AS s FROM events)
SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS text FROM s""")
def format_relative_time(spark, sf):
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), T.relative_time(F.col("ts"), now).alias("text"))


@query("""WITH s AS (SELECT l_orderkey, l_partkey, l_quantity / 7 AS a, floor(l_quantity) / 1000 AS b FROM lineitem)
SELECT l_orderkey, l_partkey, CASE WHEN a >= 1 THEN NULL ELSE '1/' || floor(1 / a + 0.5)::BIGINT || 's' END AS slow, '1/' || floor(1 / b + 0.5)::BIGINT || 's' AS fast, CASE WHEN a >= 1 AND a % 1 = 0 THEN a::BIGINT || 's' END AS whole FROM s""")
def shutter_text(spark, sf):
    a, b = F.col("l_quantity") / 7, F.floor("l_quantity") / 1000
    text = T.shutter(a)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.when(a < 1, text).alias("slow"), T.shutter(b).alias("fast"), F.when((a >= 1) & (a % 1 == 0), text).alias("whole"))


@query(r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_replace(url, '/[^/]*$', '') AS dir, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+(\.[^.]*)$', 1)) AS ext, md5(url) AS thumb_key FROM pages""")
def path_parts(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", T.basename(url).alias("base"), T.dirname(url).alias("dir"), T.extension(url).alias("ext"), F.md5(url.cast("binary")).alias("thumb_key"))


@query("SELECT page_id, CASE WHEN length(url) <= 30 THEN url ELSE left(url, 15) || '…' || right(url, 15) END AS short FROM pages")
def path_ellipsis(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.shorten(F.col("url"), 30).alias("short"))


@query("SELECT doc_id, greatest(1, floor(w * s + 0.5)::BIGINT) AS w, greatest(1, floor(h * s + 0.5)::BIGINT) AS h FROM (SELECT doc_id, w, h, least(1.0::DOUBLE, 200.0::DOUBLE / w, 200.0::DOUBLE / h) AS s FROM (SELECT doc_id, n_chars % 4000 + 1 AS w, n_chars % 3001 + 1 AS h FROM documents) a) b")
def thumbnail_sizes(spark, sf):
    w, h = F.col("n_chars") % 4000 + 1, F.col("n_chars") % 3001 + 1
    tw, th = T.thumbnail_size(w, h)
    return table(spark, sf, "documents").select("doc_id", tw.alias("w"), th.alias("h"))


_KEYS = ["Make", "ISO", "ImageWidth", "latitude", "Software", "Contrast", "FNumber", "FocalLength"]


@query(f"""WITH k AS (SELECT event_id AS id, {_KEYS}[event_id % 8 + 1] AS key, floor(value) AS v FROM events)
SELECT id, key, CASE WHEN key IN ('Make', 'Software') THEN 'Camera' WHEN key IN ('ISO', 'FNumber', 'FocalLength') THEN 'Capture' WHEN key = 'ImageWidth' THEN 'Image' WHEN key = 'latitude' THEN 'GPS' ELSE 'Other' END AS section,
 CASE key WHEN 'FNumber' THEN 'f/' || v::BIGINT WHEN 'FocalLength' THEN v::BIGINT || 'mm' WHEN 'latitude' THEN printf('%.6f', v) ELSE (v::BIGINT)::VARCHAR END AS value,
 CASE key WHEN 'ImageWidth' THEN 'Image Width' WHEN 'FocalLength' THEN 'Focal Length' ELSE key END AS label FROM k""")
def exif_sectioning(spark, sf):
    key = F.element_at(F.array(*[F.lit(k) for k in _KEYS]), (F.col("event_id") % 8 + 1).cast("int"))
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), key.alias("key"), F.floor("value").cast("double").alias("v"))
    return rows.select("id", "key", T.exif_section(F.col("key")).alias("section"), T.exif_value(F.col("key"), F.col("v")).alias("value"), T.split_camel(F.col("key")).alias("label"))


@query("SELECT event_id AS id, json_extract(props, '$.k')::INT AS k, '{\"k\":' || json_extract(props, '$.k')::INT || ',\"kind\":\"' || event_type || '\"}' AS config FROM events")
def json_config_roundtrip(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("kind"))).alias("config"))


@query("SELECT * FROM (VALUES ('phash', 'hash', 8.0::DOUBLE), ('dhash', 'hash', 10.0::DOUBLE), ('ssim', 'verify', 0.82::DOUBLE), ('nmse', 'verify', 0.05::DOUBLE)) t(id, kind, default_threshold)")
def algorithm_registry_list(spark, sf):
    rows = [(a.id, "hash", float(a.default_threshold)) for a in scans.HASHES.values()] + [(a.id, "verify", float(a.default_threshold)) for a in scans.VERIFIERS.values()]
    return spark.createDataFrame(rows, "id string, kind string, default_threshold double")


@query("SELECT * FROM (VALUES ('balanced', 'balanced'), ('fast', 'fast'), ('conservative', 'conservative'), ('precise', 'precise'), ('changed', 'custom')) t(config, preset)")
def preset_detect(spark, sf):
    changed = scans.Preset(("phash",), {"phash": 9}, "union", ("ssim",), {"ssim": 0.85})
    rows = [(name, scans.detect_preset(p)) for name, p in (*scans.PRESETS.items(), ("changed", changed))]
    return spark.createDataFrame(rows, "config string, preset string")


@query("SELECT source, lang, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source, lang")
def storage_stats(spark, sf):
    return stats.storage(table(spark, sf, "documents"), "n_chars", ["source", "lang"])


_EXISTING = "SELECT DISTINCT regexp_replace(url, '/[^/]*$', '') AS path FROM pages"
_NEW = "SELECT DISTINCT regexp_replace(url, '/[^/]*/[^/]*$', '') AS path FROM pages UNION SELECT url FROM pages"


@query(f"WITH e AS ({_EXISTING}), n AS ({_NEW}) SELECT n.path AS new_path, e.path AS existing_path, CASE WHEN n.path = e.path THEN 'same' WHEN starts_with(n.path, e.path || '/') THEN 'inside' ELSE 'around' END AS kind FROM e JOIN n ON n.path = e.path OR starts_with(n.path, e.path || '/') OR starts_with(e.path, n.path || '/')")
def folder_overlap_check(spark, sf):
    pages = table(spark, sf, "pages")
    existing = pages.select(T.dirname(F.col("url")).alias("path"))
    new = pages.select(F.regexp_replace("url", "/[^/]*/[^/]*$", "").alias("path")).union(pages.select("url"))
    return folders.folder_conflicts(existing, new)


_FILES = "files AS (SELECT *, dir || '/img_' || seq || ext AS path, strftime(date, '%Y-%m-%d_%H%M%S') AS date_name, lower(ext) AS low_ext FROM (SELECT o_orderkey AS seq, 'd' || o_custkey % 40 AS dir, '.' || o_orderpriority[1:1] || CASE WHEN o_orderkey % 2 = 0 THEN 'J' ELSE 'j' END AS ext, o_orderdate AS date FROM orders) x)"


def _files(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("d"), (F.col("o_custkey") % 40).cast("string")).alias("dir"),
        F.concat(F.lit("."), F.substring("o_orderpriority", 1, 1), F.when(F.col("o_orderkey") % 2 == 0, "J").otherwise("j")).alias("ext"),
        F.col("o_orderdate").alias("date"),
    )
    return rows.withColumn("path", F.concat("dir", F.lit("/img_"), F.col("seq").cast("string"), "ext"))


_PLAN = "SELECT seq, path AS original_path, dir || '/' || date_name || CASE WHEN count(*) OVER w > 1 THEN printf('_%03d', row_number() OVER (w ORDER BY seq)) ELSE '' END || ext AS renamed_path FROM files WINDOW w AS (PARTITION BY dir, date_name, low_ext)"


@query(f"WITH {_FILES} {_PLAN}")
def rename_plan(spark, sf):
    return organize.rename_plan(_files(spark, sf))


@query(f"WITH {_FILES} SELECT dir, date_name, low_ext, count(*) AS same FROM files GROUP BY ALL HAVING count(*) > 1")
def rename_collisions(spark, sf):
    rows = organize.named(_files(spark, sf)).where("same > 1")
    return rows.select(*organize.KEY, "same").distinct()


@query(f"WITH {_FILES}, p AS ({_PLAN}) SELECT renamed_path AS from_path, original_path AS to_path FROM p WHERE seq % 2 = 0")
def rename_undo(spark, sf):
    plan = organize.rename_plan(_files(spark, sf))
    return organize.undo_plan(plan, plan.where("seq % 2 = 0").select(F.col("renamed_path").alias("path")))


@query(f"WITH {_FILES}, p AS ({_PLAN}) SELECT (SELECT count(*) FROM files) AS total, count(*) AS renamed, (SELECT count(*) FROM files) - count(*) AS skipped FROM p WHERE renamed_path <> original_path")
def rename_job_totals(spark, sf):
    files = _files(spark, sf)
    return organize.rename_job(organize.rename_plan(files), files.count())


_SAME_KEY = "{0}.dir = {1}.dir AND {0}.date_name = {1}.date_name AND {0}.low_ext = {1}.low_ext"


@query(f"""WITH RECURSIVE {_FILES}, plan AS ({_PLAN}), taken AS (SELECT renamed_path AS path FROM plan WHERE renamed_path <> original_path AND seq % 5 = 0),
counted AS (SELECT *, count(*) OVER (PARTITION BY dir, date_name, low_ext) AS same, dir || '/' || date_name || ext AS plain FROM files),
asking AS (SELECT *, row_number() OVER (PARTITION BY dir, date_name, low_ext ORDER BY seq) AS place FROM counted WHERE same > 1 OR (plain <> path AND plain IN (SELECT path FROM taken))),
walk AS (SELECT dir, date_name, low_ext, 1::BIGINT AS place, 1::BIGINT AS n FROM asking WHERE place = 1
  UNION ALL SELECT w.dir, w.date_name, w.low_ext, w.place + CASE WHEN t.path IS NULL OR t.path = a.path THEN 1 ELSE 0 END, w.n + 1
  FROM walk w JOIN asking a ON {_SAME_KEY.format("a", "w")} AND a.place = w.place LEFT JOIN taken t ON t.path = a.dir || '/' || a.date_name || printf('_%03d', w.n) || a.ext)
SELECT seq, path AS original_path, plain AS renamed_path FROM counted c WHERE plain <> path AND NOT EXISTS (SELECT 1 FROM asking a WHERE a.seq = c.seq)
UNION ALL SELECT a.seq, a.path, max(a.dir || '/' || a.date_name || printf('_%03d', w.n) || a.ext) FROM asking a JOIN (SELECT dir, date_name, low_ext, place, max(n) AS n FROM walk GROUP BY ALL) w ON {_SAME_KEY.format("a", "w")} AND a.place = w.place GROUP BY a.seq, a.path HAVING max(a.dir || '/' || a.date_name || printf('_%03d', w.n) || a.ext) <> a.path""")
def rename_plan_around_existing(spark, sf):
    files = _files(spark, sf)
    taken = organize.rename_plan(files).where("seq % 5 = 0").select(F.col("renamed_path").alias("path"))
    return organize.rename_plan_around(files, taken)


@query("SELECT event_id AS id, coalesce(o, c, CASE WHEN b > TIMESTAMP '1970-01-01' THEN b END, ts) AS date, CASE WHEN o IS NOT NULL OR c IS NOT NULL THEN 'exif' ELSE 'file' END AS source FROM (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 1 DAY END AS o, CASE WHEN event_id % 4 = 0 THEN ts - INTERVAL 2 DAY END AS c, CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '1970-01-01' ELSE ts - INTERVAL 3 DAY END AS b FROM events) x")
def date_source_precedence(spark, sf):
    ago = lambda days: F.col("ts") - F.expr(f"INTERVAL {days} DAYS")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    date, source = organize.date_source(F.when(F.col("event_id") % 3 == 0, ago(1)), F.when(F.col("event_id") % 4 == 0, ago(2)), F.when(F.col("event_id") % 5 == 0, epoch).otherwise(ago(3)), F.col("ts"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), date.alias("date"), source.alias("source"))


@query("SELECT event_id AS id, ts, event_type AS category, event_id % 3 = 0 AS is_read FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) x WHERE ts > TIMESTAMP '2024-01-02'")
def notification_list_unread(spark, sf):
    """The newest 50: the limit is the feature."""
    log = notifications(spark, sf)
    read = log.where("id % 3 = 0").select("id")
    return notes.recent(log, 50, read, F.lit("2024-01-02").cast("timestamp_ntz")).select("id", "ts", "category", "is_read")


@query("SELECT event_id AS id, event_id % 3 = 0 AS is_read FROM events")
def notification_read_flags(spark, sf):
    log = notifications(spark, sf)
    return notes.with_read_flag(log, log.where("id % 3 = 0").select("id")).select("id", "is_read")


@query("SELECT count(*) AS entries, count(*) FILTER (event_id % 3 <> 0) AS unread FROM events WHERE ts > TIMESTAMP '2024-01-02'")
def notification_unread_count(spark, sf):
    log = notifications(spark, sf)
    return notes.unread_count(log, log.where("id % 3 = 0").select("id"), F.lit("2024-01-02").cast("timestamp_ntz"))


@query("SELECT url AS path, CASE WHEN html IS NULL THEN 'unreadable' ELSE 'empty' END AS reason FROM pages WHERE coalesce(length(html), 0) = 0 OR page_id < 0")
def scan_skipped_files(spark, sf):
    rows = table(spark, sf, "pages").select(F.col("url").alias("path"), F.filter(F.split("html", ""), lambda x: x != "").alias("grey"), F.lit(None).cast("string").alias("error"))
    return scans.skipped(rows)


@query(f"""WITH {MEDIA_SQL} SELECT seq || '.jpg' AS path, CASE WHEN NOT readable THEN 'cannot be decoded' ELSE 'empty' END AS reason FROM media WHERE NOT readable OR width = 0 OR height = 0""")
def scan_skip_reasons(spark, sf):
    """Files that a scan passes over: what decoding said of them, or that they have no pixels."""
    rows = media(spark, sf).select(
        F.concat(F.col("seq").cast("string"), F.lit(".jpg")).alias("path"),
        F.when(~F.col("readable"), "cannot be decoded").alias("error"),
        F.when((F.col("width") > 0) & (F.col("height") > 0), F.array("width", "height")).otherwise(F.array().cast("array<bigint>")).alias("grey"),
    )
    return scans.skipped(rows)


@query("SELECT DISTINCT event_id AS id FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0")
def notification_mark_read(spark, sf):
    log = notifications(spark, sf)
    return notes.mark_read(log.where("id % 3 = 0").select("id"), log.where("id % 5 = 0").select("id"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT key, id, ts, n, ts AS last, true AS keep FROM e WHERE n = 1 UNION ALL SELECT e.key, e.id, e.ts, e.n, CASE WHEN e.ts - f.last >= INTERVAL 6 HOUR THEN e.ts ELSE f.last END, e.ts - f.last >= INTERVAL 6 HOUR FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
SELECT key, id, ts FROM f WHERE keep""")
def notification_throttle(spark, sf):
    return notes.throttle(notifications(spark, sf), "user_id", 6 * 3600 * 1000)


@query("SELECT user_id, event_id AS id, k AS counter FROM (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM events) x) y WHERE k > coalesce(b, 0)")
def discovery_events(spark, sf):
    counter = F.from_json("details", "k int")["k"]
    return notes.discoveries(notifications(spark, sf), "user_id", counter).select("user_id", "id", "counter")


@query("""SELECT id, round(speed, 6) AS speed, round(CASE WHEN speed > 0 THEN (1000 - p) / speed ELSE 0 END, 6) AS remaining, least(100, greatest(0, round(p / 1000.0 * 100)))::INT AS percent
FROM (SELECT *, CASE WHEN e > 0 THEN p / e ELSE 0.0 END AS speed FROM (SELECT event_id AS id, event_id % 1001 AS p, floor(value)::DOUBLE AS e FROM events) x) y""")
def progress_eta(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 1001).alias("p"), F.floor("value").cast("double").alias("e"))
    speed, remaining, percent = stats.progress(F.col("e"), F.col("p"), F.lit(1000))
    return rows.select("id", F.round(speed, 6).alias("speed"), F.round(remaining, 6).alias("remaining"), percent.alias("percent"))


@query("""SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN 'success' WHEN event_id % 2 = 0 THEN 'abort' ELSE 'error' END AS outcome,
CASE WHEN event_type <> 'error' THEN event_id || ' files processed, {groupCount} groups found' WHEN event_id % 2 = 0 THEN 'Scan cancelled by user' ELSE 'Scan failed: disk' END AS message FROM events""")
def notification_messages(spark, sf):
    failed = F.col("event_type") == "error"
    error = F.when(F.col("event_id") % 2 == 0, "Scan aborted").otherwise("disk")
    kind = notes.outcome(failed, error)
    template = F.lit(None).cast("string")
    for name in ("success", "error", "abort"):
        template = F.when(kind == name, notes.POLICY["scan.start", name][2]).otherwise(template)
    message = notes.fill_template(template, {"processedFiles": F.col("event_id"), "groupCount": F.lit(None), "error": error})
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), kind.alias("outcome"), message.alias("message"))
