"""Every query of the reference's operators that SQL can say, against DuckDB."""

from collections import Counter

import pytest

from kindred.queries import commits, formats, relational, similarity
from tests.helpers import SF, assert_same, duck

ALL = {**relational.QUERIES, **formats.QUERIES, **similarity.QUERIES, **commits.QUERIES}
SQL = {**relational.SQL, **formats.SQL, **similarity.SQL, **commits.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert_same(ALL[name](spark, SF).toPandas(), duck().execute(SQL[name]).df())


def test_queries_without_sql_have_a_test_of_their_own():
    # The scan is held against plain loops in test_clusters.py.
    assert set(ALL) - set(SQL) == {"scan_rasters_balanced"}


def test_renames_around_existing_names_equal_the_sequential_rule(spark):
    files = sorted(formats._files(spark, SF).collect(), key=lambda r: r.seq)
    key = lambda r: (r.dir, r.date.strftime("%Y-%m-%d_%H%M%S"), r.ext.lower())
    same = Counter(map(key, files))
    disk = {r.renamed_path for r in formats.rename_plan(spark, SF).where("seq % 5 = 0").collect()}
    last, used, expected = Counter(), set(), set()
    for r in files:
        k, stem = key(r), f"{r.dir}/{key(r)[1]}"
        name = None
        if same[k] == 1:
            name = stem + r.ext
        while name is None or name in used or name in disk and name != r.path:
            last[k] += 1
            name = f"{stem}_{last[k]:03d}{r.ext}"
        used.add(name)
        if name != r.path:
            expected.add((r.seq, r.path, name))
    assert {tuple(r) for r in formats.rename_plan_around_existing(spark, SF).select("seq", "original_path", "renamed_path").collect()} == expected


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
