"""Newest-first reading of day files."""

import builtins
import json
import random
from datetime import UTC, date, datetime, timedelta

import pytest

from kindred.sources import daylog


def write_days(folder, days, each, start=date(2024, 1, 1)):
    """Entries numbered in the order they were written; every seventh line is malformed."""
    n = 0
    for d in range(days):
        day = start + timedelta(days=d)
        lines = []
        for k in range(each):
            lines.append(json.dumps({"id": f"n{n}", "timestamp": f"{day}T00:00:{k % 60:02d}Z", "level": "info", "category": "scan", "title": "é" * (k % 5), "message": "m"}, ensure_ascii=False))
            n += 1
            if k % 7 == 3:
                lines += ["{broken", "", "[1]"]
        (folder / f"notifications-{day}.log").write_text("\n".join(lines) + "\n")
    return n


@pytest.fixture
def opened(monkeypatch):
    """Paths that this process opens."""
    seen, real = [], builtins.open
    monkeypatch.setattr(builtins, "open", lambda path, *a, **k: (seen.append(str(path)), real(path, *a, **k))[1])
    return seen


def test_fifty_newest_of_a_thousand_files_open_two(spark, tmp_path, opened):
    n = write_days(tmp_path, 1000, 30)
    files = daylog.day_files(str(tmp_path))
    assert len(files) == 1000 and files[0].endswith("2026-09-26.log")
    got = [r.id for r in daylog.newest(spark, str(tmp_path), 50).collect()]
    assert got == [f"n{n - 1 - i}" for i in range(50)]
    # The same reads in this process, where they can be counted: one file, then two more in one step.
    opened.clear()
    rows, at, step = [], 0, 1
    while len(rows) < 50:
        reader = daylog.DayLogReader({"files": json.dumps(files[at : at + step]), "limit": str(50 - len(rows))})
        rows += [r for p in reader.partitions() for r in reader.read(p)]
        at, step = at + step, step * 2
    assert len({p for p in opened if p.endswith(".log")}) == 3 and at == 3


def test_a_long_file_is_read_from_its_end_only(tmp_path, monkeypatch):
    write_days(tmp_path, 1, 50_000)
    path, read = daylog.day_files(str(tmp_path))[0], []
    real = builtins.open

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.inner.close()

        def seek(self, *a):
            return self.inner.seek(*a)

        def read(self, n):
            read.append(n)
            return self.inner.read(n)

    monkeypatch.setattr(builtins, "open", lambda p, *a, **k: Counted(real(p, *a, **k)) if str(p) == path else real(p, *a, **k))
    reader = daylog.DayLogReader({"files": json.dumps([path]), "limit": "50"})
    assert len(list(reader.read(reader.partitions()[0]))) == 50 and sum(read) == daylog.BLOCK


@pytest.mark.parametrize("block", [1, 2, 7, 64, 10_000])
def test_lines_from_the_end_at_any_block(tmp_path, block):
    draw = random.Random(block)
    for k, text in enumerate([b"", b"\n", b"\n\n\n", b"a", b"a\n", b"\na", b"a\n\nbb\n" + b"c" * 500 + b"\nd", bytes(draw.choices(b"ab\n", k=300))]):
        path = tmp_path / f"{k}.log"
        path.write_bytes(text)
        expected, at = [], 0
        for line in text.split(b"\n"):
            if line:
                expected.append((at, line))
            at += len(line) + 1
        assert list(daylog.lines_from_end(str(path), block)) == expected[::-1]
        found = [x for s in range(0, len(text), block) for x in daylog.lines_of_range(str(path), s, min(s + block, len(text)))]
        assert [x for x in found if x[1]] == expected


def test_whole_days_in_ranges_and_pruned(spark, tmp_path):
    n = write_days(tmp_path, 6, 40)
    assert sorted(r.id for r in daylog.entries(spark, str(tmp_path), range_bytes=500).collect()) == sorted(f"n{i}" for i in range(n))
    some = daylog.entries(spark, str(tmp_path), since=date(2024, 1, 3), until=date(2024, 1, 4))
    assert sorted(r.file for r in some.select("file").distinct().collect()) == ["notifications-2024-01-03.log", "notifications-2024-01-04.log"]
    assert some.count() == 80 and some.rdd.getNumPartitions() == 2


def test_no_folder_more_wanted_than_there_is_and_odd_values(spark, tmp_path):
    assert daylog.newest(spark, str(tmp_path / "none"), 5).count() == 0
    (tmp_path / "notifications-2024-01-01.log").write_text('{"id": 7, "timestamp": "soon", "details": {"a": 1}}\n{"message": null}')
    (tmp_path / "notifications-2024-01-02.log").mkdir()
    (tmp_path / "other-2024-01-03.log").write_text('{"id": "x"}')
    rows = daylog.newest(spark, str(tmp_path), 50).collect()
    assert [(r.id, r.timestamp, r.details) for r in rows] == [(None, None, None), ("7", None, "{'a': 1}")]


def test_appended_entries_come_back_newest_first(spark, tmp_path):
    for k in range(5):
        daylog.append(str(tmp_path), {"id": f"n{k}", "level": "info", "message": "zeile\nzwei é"}, now=datetime(2024, 1, 1, 20, tzinfo=UTC) + timedelta(hours=2 * k))
    assert [p[-14:-4] for p in daylog.day_files(str(tmp_path))] == ["2024-01-02", "2024-01-01"]
    rows = daylog.newest(spark, str(tmp_path), 4).collect()
    assert [r.id for r in rows] == ["n4", "n3", "n2", "n1"] and rows[0].message == "zeile\nzwei é"
