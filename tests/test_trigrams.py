"""The trigram index against a scan with the same pattern."""

import random

import pyspark.sql.functions as F
import pytest

from kindred.operators import trigrams
from kindred.plans import scan as scans

WORDS = ["holiday", "Ünïcode", "IMG_2024", "a%b", "x", "", None, "back\\slash", "HOLIDAY-beach", "beach day"]


@pytest.fixture(scope="module")
def index(spark):
    draw = random.Random(3)
    rows = [(i, None if (w := draw.choice(WORDS)) is None else f"{w}{draw.choice(['', '.jpg', f'_{i}.JPG'])}") for i in range(600)]
    return trigrams.build(spark.createDataFrame(rows, "id long, text string"), folders=16)


@pytest.mark.parametrize("pattern", ["%holiday%", "%HOLI_AY%", "%img\\_2024%", "%a\\%b%", "%ünï%", "x", "%", "", "%zzz%", "hol%day%", "%lid%jpg%", "%ay", "%ck\\\\sl%", "%beach day%", "%ab%"])
def test_search_equals_the_scan(index, pattern):
    expected = index.rows.where(F.col("text").ilike(pattern))
    assert sorted(r.id for r in index.search(pattern).collect()) == sorted(r.id for r in expected.collect())


def test_only_the_folders_of_the_rarest_trigrams_are_read(index):
    grams = index.rarest("%holiday%")
    assert len(grams) == 3 and grams == sorted(grams, key=lambda x: (x[1], x[0]))
    read = index._read("postings", "gram string, id long", sorted({k for _, _, k in grams})).inputFiles()
    everything = index.spark.read.parquet(f"{index.path}/postings").inputFiles()
    assert 0 < len(read) <= len(everything) / 3
    assert index.rarest("%a_b%") is None and index.rarest("%zzz%")[0][1] == 0


def test_patterns_split_at_wildcards():
    assert trigrams.literal_runs("%ab\\%c_d%") == ["ab%c", "d"] and trigrams.literal_runs("%_%") == []


def test_an_empty_index_finds_nothing(spark):
    none = trigrams.build(spark.createDataFrame([], "id long, text string"), folders=2)
    assert none.search("%abc%").count() == 0 and none.search("%").count() == 0


def test_presets_of_stored_settings(spark):
    rows = [(n, scans.json.dumps({k: getattr(p, k) for k in ("hash_algorithms", "hash_thresholds", "merge_strategy", "verify_algorithms", "verify_thresholds")})) for n, p in scans.PRESETS.items()]
    rows += [("custom", '{"hash_thresholds": {}}'), ("custom", None), ("custom", "[")]
    got = spark.createDataFrame(rows, "name string, config string").select("name", scans.config_presets(F.col("config")).alias("preset")).collect()
    assert all(r.name == r.preset for r in got)


def test_every_move_between_scan_states(spark):
    states = ["running", "paused", "completed", "failed", "cancelled"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(states)], "id long, status string")
    for status in states:
        after = {r.id: r for r in scans.set_status(rows, F.lit(True), status, F.lit("2024-01-01").cast("timestamp_ntz"), "why").collect()}
        for i, before in enumerate(states):
            moved = before in scans.FOLLOWS[status]
            assert after[i].status == (status if moved else before)
            assert (after[i].ended_at is not None) == (moved and status in ("completed", "failed", "cancelled"))
            assert after[i].error_message == ("why" if moved and status == "failed" else None)


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(trigrams, "DEAL_ROWS", 100)
    rows = spark.range(2000).select("id", F.concat(F.lit("img_"), F.col("id").cast("string")).alias("text"))
    index = trigrams.build(rows, folders=2)
    held = spark.read.parquet(f"{index.path}/postings")
    largest = held.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert largest < held.count() / 9  # of two folders in four parts each, one part holds an eighth at least
    assert sorted(r.id for r in index.search("%g_19%").collect()) == sorted(i for i in range(2000) if str(i).startswith("19"))
