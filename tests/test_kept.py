"""Kept aggregates and deep pages against recomputation."""

import random
from datetime import datetime, timedelta

import pyspark.sql.functions as F
import pytest

from kindred.operators import pages, rollups
from kindred.plans.trash import trash_summary
from kindred.storage import materialise

TRASH = "id long, status string, expires_at timestamp_ntz, size long"


def test_kept_summary_equals_recomputation_after_random_changes(spark):
    draw, start, stored, table, n = random.Random(9), datetime(2024, 1, 1), None, {}, 0
    frame = lambda rows: spark.createDataFrame(list(rows), TRASH)
    for step in range(8):
        gone, come = [], []
        for key in draw.sample(sorted(table), min(len(table), draw.randint(0, 25))):
            row = table.pop(key)
            gone.append(row)
            if draw.random() < 0.6:
                table[key] = (key, draw.choice(["trashed", "restored", "purged", None]), row[2], row[3])
                come.append(table[key])
        for _ in range(draw.randint(0, 30) if step < 6 else 0):
            table[n] = (n, "trashed", draw.choice([None, start + timedelta(days=draw.randint(0, 9))]), draw.choice([None, draw.randint(0, 99)]))
            come.append(table[n])
            n += 1
        if step == 6:  # the earliest expiry goes
            least = min((r[2] for r in table.values() if r[1] == "trashed" and r[2]), default=None)
            for key in [k for k, r in table.items() if r[2] == least and k not in {x[0] for x in come}]:
                gone.append(table.pop(key))
        made = rollups.TRASH.build(frame(come)) if stored is None else rollups.TRASH.fold(stored, frame(gone), frame(come))
        stored = materialise(made, "kept")
        assert rollups.trash_summary(stored).first() == trash_summary(frame(table.values())).first()
        expected = {tuple(r) for r in rollups.TRASH.build(frame(table.values())).collect()}
        assert {tuple(r) for r in stored.collect()} == expected


def test_removing_what_is_not_there_is_an_error(spark):
    stored = rollups.TRASH.build(spark.createDataFrame([(1, "trashed", datetime(2024, 1, 1), 5)], TRASH))
    with pytest.raises(Exception, match="more rows removed"):
        rollups.TRASH.fold(stored, spark.createDataFrame([(2, "trashed", datetime(2024, 1, 2), 5)], TRASH)).collect()
    assert rollups.TRASH.fold(stored, stored.select(F.lit(1).alias("id"), "status", "expires_at", "size")).count() == 0
    assert rollups.trash_summary(rollups.TRASH.fold(stored.where("false"))).first()[:2] == (0, 0)


def test_every_page_equals_sort_and_offset(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice([None, *range(5)]), f"x{i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, k int, name string")
    index = pages.build(frame, [F.desc("k"), F.asc("id")], ranges=6)
    assert index.total == 200 and len(index.counts) > 2
    ordered = [tuple(r) for r in frame.orderBy(F.desc("k"), "id").collect()]
    for offset in [*range(0, 200, 23), 199, 200, 1000]:
        assert [tuple(r) for r in index.page(offset, 17).collect()] == ordered[offset : offset + 17]
    for offset in range(201):
        hit, before = index.ranges(offset, 10)
        assert len(hit) <= 2 or min(index.counts[k] for k in hit[1:-1]) < 10
        assert not hit or before <= offset < before + index.counts[hit[0]]
    assert index.page(3, 0).count() == 0


def test_a_page_reads_its_ranges_and_sorts_nothing_else(spark):
    frame = spark.range(10_000).select("id", (F.col("id") % 7).alias("k"))
    index = pages.build(frame, [F.asc("k"), F.desc("id")], range_rows=500)
    page = index.page(9_000, 20)
    read = {f.rpartition("/_range=")[2].partition("/")[0] for f in page.inputFiles()}
    assert 1 <= len(read) <= 2 and len(index.counts) == 20
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_a_very_frequent_value_is_split_and_an_empty_table_has_no_page(spark):
    frame = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    index = pages.build(frame, [F.asc("k"), F.asc("id")], ranges=10)
    assert max(index.counts) < 1500
    none = pages.build(frame.where("false"), [F.asc("id")])
    assert none.total == 0 and none.page(0, 5).count() == 0
