"""Renames, notifications, folders, filters, trash, sources and streams."""

import json
import random
from collections import Counter
from datetime import date, datetime

import pyspark.sql.functions as F
import pytest

from kindred.functions import text as T
from kindred.operators.filters import MetadataFilter, keywords
from kindred.plans import folders, organize, review, trash
from kindred.plans import notifications as notes
from kindred.plans import scan as scans
from kindred.sources import files, logs
from kindred.streaming.notifications import throttle_stream

FILE = "seq long, dir string, path string, ext string, date timestamp_ntz"
T0, T1 = datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 6)


def test_rename_numbers_only_collisions(spark):
    rows = [(1, "d", "d/a.jpg", ".jpg", T0), (2, "d", "d/b.JPG", ".JPG", T0), (3, "d", "d/c.png", ".png", T0), (4, "e", "e/2024-01-02_030406.jpg", ".jpg", T1)]
    got = {r["seq"]: r["renamed_path"] for r in organize.rename_plan(spark.createDataFrame(rows, FILE)).collect()}
    assert got == {1: "d/2024-01-02_030405_001.jpg", 2: "d/2024-01-02_030405_002.JPG", 3: "d/2024-01-02_030405.png"}


def test_rename_goes_around_names_in_use(spark):
    rows = spark.createDataFrame([(1, "d", "d/a.jpg", ".jpg", T0), (2, "d", "d/b.jpg", ".jpg", T1), (3, "d", "d/c.jpg", ".jpg", T1)], FILE)
    used = spark.createDataFrame([("d/2024-01-02_030405.jpg",), ("d/2024-01-02_030406_001.jpg",)], "path string")
    got = {r["seq"]: r["renamed_path"] for r in organize.rename_plan_around(rows, used).collect()}
    assert got == {1: "d/2024-01-02_030405_001.jpg", 2: "d/2024-01-02_030406_002.jpg", 3: "d/2024-01-02_030406_003.jpg"}


def test_rename_around_nothing_is_the_plain_plan(spark):
    rows = spark.createDataFrame([(i, f"d{i % 2}", f"d{i % 2}/{i}.jpg", ".jpg", T0) for i in range(7)], FILE)
    key = lambda f: sorted(map(tuple, f.collect()))
    assert key(organize.rename_plan(rows)) == key(organize.rename_plan_around(rows, spark.createDataFrame([], "path string")))


def sequential_names(files, disk):
    """The rule, one file after the other; files are (seq, dir, path, ext, date)."""
    key = lambda f: (f[1], f[4].strftime("%Y-%m-%d_%H%M%S"), f[3].lower())
    same, last, used, out = Counter(map(key, files)), Counter(), set(), {}
    for f in sorted(files):
        k, stem = key(f), f"{f[1]}/{key(f)[1]}"
        name = stem + f[3] if same[k] == 1 else None
        while name is None or name in used or (name in disk and name != f[2]):
            last[k] += 1
            name = f"{stem}_{last[k]:03d}{f[3]}"
        used.add(name)
        if name != f[2]:
            out[f[0]] = name
    return out


@pytest.mark.parametrize("seed", range(6))
def test_rename_around_equals_the_sequential_rule(spark, seed):
    """Many keys of one call: own names in any order, two spellings of the extension, dense and sparse names in use."""
    rng = random.Random(seed)
    files, disk, seq = [], set(), 0
    for d in range(12):
        stem = f"d{d}/{T0.strftime('%Y-%m-%d_%H%M%S')}"
        exts = rng.choice([[".jpg"], [".jpg", ".JPG"]])
        many = rng.choice([1, 2, 5, 12])
        names = [f"{stem}_{n:03d}{e}" for n in range(1, 16) for e in exts] + [stem + e for e in exts]
        rng.shuffle(names)
        named_already = rng.choice([0.0, 0.5, 1.0])
        for k in range(many):
            seq += 1
            path = names.pop() if rng.random() < named_already else f"d{d}/x{k}.jpg"
            files.append((seq, f"d{d}", path, "." + path.rsplit(".", 1)[1], T0))
            disk.add(path)
        disk |= {x for x in names if rng.random() < rng.choice([0.1, 0.8])}
    disk |= {"d0/other.jpg", f"d1/{T0.strftime('%Y-%m-%d_%H%M%S')}_1.jpg", "top.jpg"}
    rows = organize.rename_plan_around(spark.createDataFrame(files, FILE), spark.createDataFrame([(p,) for p in disk] + [(None,)], "path string"))
    assert {r["seq"]: r["renamed_path"] for r in rows.collect()} == sequential_names(files, disk)


def test_rename_numbers_past_three_digits_and_files_without_date(spark):
    files = [(i, "d", f"d/{i}.jpg", ".jpg", T0) for i in range(1, 1203)] + [(5000, "d", "d/z.jpg", ".jpg", None)]
    rows = spark.createDataFrame(files, FILE)
    stem = f"d/{T0.strftime('%Y-%m-%d_%H%M%S')}"
    plain = {r["seq"]: r["renamed_path"] for r in organize.rename_plan(rows).collect()}
    assert plain[1000] == f"{stem}_1000.jpg" and len(set(plain.values())) == len(plain) == 1202
    disk = {f"{stem}_{n:03d}.jpg" for n in range(2, 1100, 2)}
    around = {r["seq"]: r["renamed_path"] for r in organize.rename_plan_around(rows, spark.createDataFrame([(p,) for p in disk], "path string")).collect()}
    assert around == sequential_names(files[:-1], disk)


def test_rename_around_shuffles_once_however_many_names_are_skipped(spark, monkeypatch):
    """Each further skip that waits for one before used to take a round and a table of its own."""
    stem = f"d/{T0.strftime('%Y-%m-%d_%H%M%S')}"
    files = [(i, "d", f"d/{i}.jpg", ".jpg" if i % 2 else ".JPG", T0) for i in range(1, 60)]
    disk = {f"{stem}_{n:03d}{e}" for n in range(1, 90, 3) for e in ((".jpg",), (".JPG",), (".jpg", ".JPG"))[n % 3]}
    plan = organize.rename_plan_around(spark.createDataFrame(files, FILE), spark.createDataFrame([(p,) for p in disk], "path string"))
    assert {r["seq"]: r["renamed_path"] for r in plan.collect()} == sequential_names(files, disk)
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("RepartitionByExpression") == 1 and "Join" not in shown


def events(spark, seconds):
    return spark.createDataFrame([(1, i, datetime(2024, 1, 1, 0, 0, 0, int(s * 1000) % 1_000_000)) for i, s in enumerate(seconds)], "user_id long, id long, ts timestamp_ntz")


def test_throttle(spark):
    kept = notes.throttle(events(spark, [0, 10, 199, 200, 350, 401]), "user_id", 200).collect()
    assert sorted(r["id"] for r in kept) == [0, 3, 5]


def test_throttle_stream_equals_batch(spark, tmp_path):
    rows = events(spark, [0, 10, 199, 200, 350, 401])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = throttle_stream(stream, "user_id", 200).writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["id"] for r in spark.table("throttled").collect()) == [0, 3, 5]


def test_folder_conflicts(spark):
    old = spark.createDataFrame([("/a/b",), ("/c",)], "path string")
    new = spark.createDataFrame([("/a/b",), ("/a/b/x",), ("/a",), ("/a/bc",), ("/cc",)], "path string")
    assert {tuple(r) for r in folders.folder_conflicts(old, new).collect()} == {("/a/b", "/a/b", "same"), ("/a/b/x", "/a/b", "inside"), ("/a", "/a/b", "around")}


def test_metadata_filter_truth_table(spark):
    rows = [(0, "Canon X", date(2024, 1, 1), 1, 100, 100, True), (1, None, None, None, 0, 0, True), (2, "Nikon", date(2023, 1, 1), None, 50, 0, True), (3, None, None, None, None, None, False)]
    media = spark.createDataFrame(rows, "seq long, camera string, taken_on date, latitude int, width int, height int, readable boolean")
    keep = lambda f: sorted(r["seq"] for r in f.split(media)[0].collect())
    assert keep(MetadataFilter()) == [0, 1, 2, 3]
    assert keep(MetadataFilter(start=date(2024, 1, 1), end=date(2024, 1, 1))) == [0, 1, 3]
    assert keep(MetadataFilter(cameras=keywords("nikon, ,CANON"))) == [0, 2]
    assert keep(MetadataFilter(gps="with_gps")) == [0]
    assert keep(MetadataFilter(gps="without_gps")) == [1, 2, 3]
    assert keep(MetadataFilter(least_width=80)) == [0, 1, 3]
    assert MetadataFilter(least_width=80).split(media)[1].first()["excluded"] == 1


def test_trash_cycle(spark):
    photos = spark.createDataFrame([(1, 7, "a.jpg", 10), (2, 7, "b.jpg", 5)], "id long, group_id long, filename string, file_size long")
    held = spark.createDataFrame([("t", 1, 10, "trashed", T0, T1)], "trash_id string, photo_id long, size long, status string, deleted_at timestamp_ntz, expires_at timestamp_ntz")
    now = F.lit("2024-05-01").cast("timestamp_ntz")
    moved = trash.move_to_trash(photos, held, F.lit(True), now).collect()
    assert [(r["photo_id"], r["status"]) for r in moved] == [(2, "trashed")]
    assert moved[0]["expires_at"] == datetime(2024, 5, 31)
    assert trash.expired(held, F.lit(T1)).count() == 0
    assert trash.purge(held, F.col("expires_at") < now).first()["status"] == "purged"
    assert trash.restore(held, F.lit(True), now).first()["status"] == "restored"
    empty = trash.trash_summary(held.where("false")).first()
    assert (empty["total_files"], empty["total_size"], empty["next_cleanup"]) == (0, 0, None)


def test_change_master_ignores_strangers(spark):
    photos = spark.createDataFrame([(1, 7, 10000, True), (2, 7, 2000, False), (3, 8, 5, True)], "id long, group_id long, file_size long, is_master boolean")
    groups = spark.createDataFrame([(7, 12000, 2000, 1), (8, 5, 0, 3)], "id long, total_size long, reclaimable_size long, master_id long")
    after, moved = review.change_master(photos, groups, spark.createDataFrame([(7, 2), (8, 1)], "group_id long, photo_id long"))
    assert {(r["id"], r["reclaimable_size"], r["master_id"]) for r in moved.collect()} == {(7, 10000, 2), (8, 0, 3)}
    assert {r["id"] for r in after.where("is_master").collect()} == {2, 3}


def test_listing_sizes_and_validation(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("photo1.jpg", "photo2.PNG", "readme.txt", "data.csv", ".hidden.jpg", "sub/photo3.jpeg"):
        (tmp_path / name).write_bytes(b"abc")
    (tmp_path / "none").mkdir()
    names = lambda *f: sorted(r["filename"] for r in files.list_images(spark, list(f)).collect())
    assert names((str(tmp_path), True)) == ["photo1.jpg", "photo2.PNG", "photo3.jpeg"]
    assert names((str(tmp_path), False)) == ["photo1.jpg", "photo2.PNG"]
    assert names((str(tmp_path / "missing"), True)) == []
    assert files.directory_size(spark, str(tmp_path)).first()["bytes"] == 15
    assert files.validate_folder(str(tmp_path))["valid"]
    assert files.validate_folder(str(tmp_path / "photo1.jpg"))["reason"] == "not a folder"


def test_logs_and_settings(spark, tmp_path):
    lines = [json.dumps({"id": str(i), "timestamp": f"2024-01-0{i + 1}T00:00:00Z", "level": "info", "category": "scan", "title": "t", "message": "m"}) for i in range(3)]
    (tmp_path / "a.jsonl").write_text("\n".join([*lines, "{broken"]))
    assert [r["id"] for r in logs.recent_entries(logs.read_log(spark, str(tmp_path)), 2).collect()] == ["2", "1"]
    assert logs.load_settings("{bad") == logs.DEFAULTS
    now = logs.load_settings('{"ui": {"theme": "dark"}}')
    assert now["ui"]["theme"] == "dark"
    assert now["ui"]["language"] == "ko"
    assert logs.reset_settings(logs.save_settings(now, "data", {"trashRetentionDays": 1}), "data")["data"]["trashRetentionDays"] == 30
    with pytest.raises(KeyError):
        logs.save_settings(now, "nope", {})


def test_templates_and_text(spark):
    row = spark.range(1).select(
        notes.fill_template(F.lit("{a} of {b} {c}"), {"a": F.lit(3), "b": F.lit(None)}).alias("filled"),
        T.format_bytes(F.lit(1536)).alias("size"),
        T.format_bytes(F.lit(0)).alias("none"),
        T.shorten(F.lit("x" * 80)).alias("short"),
        T.split_camel(F.lit("FocalLength")).alias("camel"),
        T.version_number(F.lit("v1.2")).alias("version"),
    ).first()
    assert row["filled"] == "3 of {b} {c}"
    assert (row["size"], row["none"]) == ("1.5 KB", "0 B")
    assert len(row["short"]) == 61
    assert (row["camel"], row["version"]) == ("Focal Length", "1.2")


def test_flat_listing_of_empty_and_relative_folders(spark, tmp_path, monkeypatch):
    for name in ("pics/oldpics/b.jpg", "pics/a b.jpg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "none").mkdir()
    monkeypatch.chdir(tmp_path)
    names = lambda f: [r["filename"] for r in files.list_images(spark, [(f, False)]).collect()]
    assert names("none") == []
    assert names("pics") == ["a b.jpg"]


def test_folders_are_added_and_removed(spark):
    watched = spark.createDataFrame([("/a/b", True)], "path string, include_subfolders boolean")
    assert sorted(r["path"] for r in folders.add_folder(watched, "/c").collect()) == ["/a/b", "/c"]
    for taken in ("/a/b", "/a", "/a/b/x"):
        with pytest.raises(ValueError, match="/a"):
            folders.add_folder(watched, taken)
    assert folders.remove_folder(watched, "/a/b").count() == 0
    with pytest.raises(KeyError):
        folders.remove_folder(watched, "/a")


def test_skipped_files_have_one_reason_each(spark):
    rows = [("p", [1], None), ("q", None, None), ("q", None, "broken"), ("r", [], None)]
    got = scans.skipped(spark.createDataFrame(rows, "path string, grey array<int>, error string")).collect()
    assert {(r["path"], r["reason"]) for r in got} == {("q", "broken"), ("r", "empty")}
