"""Ordered rules on streams against the batch rules, over micro-batches and a restart."""

import random
from datetime import UTC, datetime, timedelta

import pyspark.sql.functions as F
import pytest

from kindred.plans import notifications as notes
from kindred.sources import files
from kindred.streaming import ordered

EVENT = "user string, id long, ts timestamp, k int"
START = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ordered.state_store(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def event(user, i, seconds, k=None):
    return (user, i, None if seconds is None else START + timedelta(seconds=seconds), k)


def run(spark, folder, batches, rule, restart_after=None):
    """All output rows of a stream that gets the batches one by one, with the same checkpoint after a restart."""
    cut = len(batches) if restart_after is None else restart_after
    for part in (batches[:cut], batches[cut:]):
        for rows in part:
            spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if part:
            stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            rule(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()]


def batches_of(seed, n=120, parts=4):
    """Events whose order inside a micro-batch is random and across them off by less than the delay; then a heartbeat."""
    draw = random.Random(seed)
    rows = [event(draw.choice(["a", "b", None]), i, i * 0.7 + draw.random(), draw.choice([None, draw.randint(0, 9)])) for i in range(n)]
    size = n // parts
    out = [rows[i * size : (i + 1) * size] for i in range(parts)]
    out[0][-3:], out[1][:3] = out[1][:3], out[0][-3:]  # neighbours change places
    for part in out:
        draw.shuffle(part)
    return [*out, [event("a", None, 10_000)]], rows


def test_throttle_equals_the_batch_rule_over_batches_and_a_restart(rocks, tmp_path):
    parts, rows = batches_of(1)
    got = run(rocks, str(tmp_path), parts, lambda s: ordered.throttle_in_order(s, "user", 3000), restart_after=2)
    expected = notes.throttle(rocks.createDataFrame(rows, EVENT), "user", 3000)
    assert sorted((r[0] or "", r[1]) for r in got) == sorted((r.key or "", r.id) for r in expected.collect())
    assert {r[2].second for r in got} and len(got) < len(rows)


def test_discoveries_equal_the_batch_rule(rocks, tmp_path):
    parts, rows = batches_of(2)
    got = run(rocks, str(tmp_path), parts, lambda s: ordered.discoveries_in_order(s, "user", F.col("k")))
    expected = notes.discoveries(rocks.createDataFrame(rows, EVENT), "user", F.col("k")).collect()
    assert sorted((r[0] or "", r[1], r[3], r[4]) for r in got if r[4] is not None) == sorted((r.user or "", r.id, r.counter, r.before) for r in expected if r.before is not None)
    assert sorted((r[0] or "", r[1], r[3]) for r in got) == sorted((r.user or "", r.id, r.counter) for r in expected)


def test_late_rows_go_and_nothing_waits_after_a_heartbeat(rocks, tmp_path):
    parts = [[event("a", 1, 100)], [event("a", 2, 200)], [event("a", 3, 50), event("a", 4, 195), event("b", 5, None)], [event("a", None, 900)]]
    got = run(rocks, str(tmp_path), parts, lambda s: ordered.throttle_in_order(s, "user", 1000))
    assert sorted(r[1] for r in got) == [1, 2, 4]  # 3 is older than the watermark of 190 seconds, 5 has no time


def test_images_arrive_as_a_stream(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    seen = []
    for names in (["a.jpg", "b.txt"], ["sub/c.PNG", "sub/d.md"]):
        for n in names:
            (tmp_path / "in" / n).write_bytes(b"xyz")
        stream = files.image_stream(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
        stream.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        seen.append(sorted(r.path.rpartition("/")[2] for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert seen == [["a.jpg"], ["a.jpg", "c.PNG"]]
