"""URL filters: a blocked Bloom filter in front of an exact hash join.

Listed canonical URLs are (host, path) rules with a verdict.  A page's host
and its parent domains, each with the path prefixes whose lengths occur in the
list, are the only keys under which a rule could fit it.  A blocked Bloom
filter over the listed keys (one 64-bit block a key, so one memory access a
test) lets possible hits through; those alone meet the list in an equi-join,
which removes false positives, and the longest rule wins.

The test is narrow: rows that cannot be hits are judged where they were read
and are never shuffled, among them all null urls.  Possible hits meet the list
once per distinct (host, path), and Spark may split a url that very many rows
share when the verdicts come back, as it has one verdict.  The filter's size is
a parameter and stays the same however long the list is; a fuller filter passes
more possible hits to the join and changes no result.

Defined results: a null url or one without ``://`` has empty host and path,
fits no rule and gets the default verdict; a rule with a null host or path is
ignored; of rules of equal length the smallest text wins, then ``allow``;
repeated rows each give a row; an empty list or table is fine.
"""

from __future__ import annotations

import string
from functools import reduce

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

BLOCKS = 1 << 16
HASHES = 4

#: Fixed values of the contract: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or without ``://``."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, shape, 1)), F.regexp_extract(text, shape, 2)


def _bits(column: str) -> Column:
    """``HASHES`` bits of a 64-bit block, from the hash's upper bits."""
    bits = [F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {40 + 6 * k}) & 63 as int))") for k in range(HASHES)]
    return reduce(Column.bitwiseOR, bits)


def build_filter(keys: DataFrame, blocks: int = BLOCKS) -> np.ndarray:
    """Blocks of a Bloom filter over column ``key``; at most ``blocks`` rows reach the driver."""
    coded = keys.select(F.xxhash64("key").alias("_hash")).select(F.pmod("_hash", F.lit(blocks)).cast("int").alias("block"), _bits("_hash").alias("bits"))
    words = np.zeros(blocks, np.int64)
    for row in coded.groupBy("block").agg(F.bit_or("bits").alias("bits")).collect():
        words[row["block"]] = row["bits"]
    return words


def maybe_listed(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether the filter may hold keys of these hashes (Spark's xxhash64)."""
    bits = np.zeros(len(h), np.int64)
    for k in range(HASHES):
        bits |= np.int64(1) << ((h.view(np.uint64) >> np.uint64(40 + 6 * k)) & np.uint64(63)).astype(np.int64)
    return (words[h % len(words)] & bits) == bits


def possible_hit(hashes: Column, words: np.ndarray, spark: SparkSession) -> Column:
    """Whether the filter may hold any key of an array of hashes."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        size = np.array([len(k) for k in keys], np.int64)
        if not size.sum():
            return pd.Series(np.zeros(len(keys), bool))
        maybe = maybe_listed(np.concatenate(keys.to_list()).astype(np.int64), shared.value)
        owner = np.repeat(np.arange(len(keys)), size)
        return pd.Series(np.bincount(owner[maybe], minlength=len(keys)) > 0)

    return test(hashes)


def possible_hits(candidates: DataFrame, words: np.ndarray) -> DataFrame:
    """The rows whose ``key`` may be listed."""
    return candidates.where(possible_hit(F.array(F.xxhash64("key")), words, candidates.sparkSession))


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", blocks: int = BLOCKS) -> DataFrame:
    """Add host, path, rule and verdict to ``pages``.

    ``rules`` has verdict, host and path; columns of ``pages`` with one of the
    added names are replaced.
    """
    host, path = url_parts(F.col(url_col))
    kept = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    parted = pages.select(*kept, host.alias("host"), path.alias("path"))
    listed = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(F.concat(ascii_lower(F.col("host")), "path").alias("key"), "verdict", F.size(F.split("host", "[.]")).alias("labels"), F.length("path").alias("prefix"))
    shapes = listed.select("labels", "prefix").distinct().collect()  # label counts x path lengths
    words = build_filter(listed, blocks)
    labels = F.size(F.split("host", "[.]"))
    tails = [F.when((labels >= s["labels"]) & (F.length("path") >= s["prefix"]), F.concat(F.substring_index("host", ".", -s["labels"]), F.substring("path", 1, s["prefix"]))) for s in shapes]
    keys = F.array_compact(F.array(*tails)) if tails else F.array().cast("array<string>")
    marked = parted.withColumn("_keys", keys).withColumn("_maybe", possible_hit(F.transform("_keys", lambda k: F.xxhash64(k)), words, pages.sparkSession))
    hits, others = marked.where("_maybe"), marked.where("NOT _maybe")
    candidates = hits.select("host", "path", "_keys").distinct().select("host", "path", F.explode("_keys").alias("key"))
    found = possible_hits(candidates, words).join(listed.select("key", "verdict"), "key")
    best = found.groupBy("host", "path").agg(F.min(F.struct((-F.length("key")).alias("order"), "key", "verdict")).alias("_best"))
    judged = hits.join(best, ["host", "path"], "left").select(*kept, "host", "path", F.col("_best.key").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
    return judged.unionByName(others.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the five fixed rules over all pages."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH parted AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path,
         row_number() OVER () AS n
  FROM pages
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), best AS (
  SELECT p.n, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.n ORDER BY length(r.rhost || r.rpath) DESC, r.rhost || r.rpath, r.verdict) AS k
  FROM parted p JOIN rules r
    ON (p.host = r.rhost OR p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath)
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parted p LEFT JOIN best b ON b.n = p.n AND b.k = 1
"""
