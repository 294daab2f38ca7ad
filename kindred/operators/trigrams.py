"""Substring search by a stored index of trigrams.

``build`` stores every distinct trigram of a lower-cased text with the row's id, in
folders by a hash of the trigram, and how many rows each trigram has.  A search
takes the trigrams of the pattern's literal runs, looks up their frequencies in
the few folders where they can be, joins the ids of the rarest ones and tests
the texts of those candidates with the pattern itself, so results are those of
a scan.  A pattern without three literal characters in a row is a scan.

In a pattern ``%`` stands for any text, ``_`` for one character, a backslash for
the literal next one, as in LIKE.  Null texts match nothing.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from kindred.storage import shared_dir

FOLDERS = 64
RAREST = 3
DEAL = 4  # parts of a folder at least
DEAL_ROWS = 1_000_000  # indexed rows a part
TASKS_A_PART = 16


def _grams(text: Column) -> Column:
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.greatest(F.char_length(low) - 2, F.lit(1)))
    return F.when(F.char_length(low) >= 3, F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def literal_runs(pattern: str) -> list[str]:
    """Stretches of the pattern between wildcards."""
    runs = [""]
    for part in re.findall(r"\\.|%|_|[^\\%_]+|\\", pattern, re.S):
        if part in "%_":
            runs.append("")
        else:
            runs[-1] += part[1:] if part.startswith("\\") and len(part) == 2 else part
    return [r for r in runs if r]


@dataclass(frozen=True)
class TrigramIndex:
    spark: SparkSession
    path: str
    rows: DataFrame  # id, text
    folders: int

    def _read(self, kind: str, schema: str, folders: list[int]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{kind}/_folder={k}" for k in folders))

    def rarest(self, pattern: str, most: int = RAREST) -> list[tuple[str, int, int]] | None:
        """(gram, its rows, its folder) of the rarest trigrams; None if the pattern has none, rows 0 if one is unknown."""
        runs = F.array(*(F.lit(r) for r in literal_runs(pattern))) if literal_runs(pattern) else F.array().cast("array<string>")
        gram = F.explode(F.array_distinct(F.flatten(F.transform(runs, _grams)))).alias("gram")
        wanted = {r.gram: r.folder for r in self.spark.range(1).select(gram).select("gram", _folder(F.col("gram"), self.folders).alias("folder")).collect()}
        if not wanted:
            return None
        counts = self._read("counts", "gram string, n bigint", sorted(set(wanted.values()))).where(F.col("gram").isin(list(wanted)))
        found = {r.gram: r.n for r in counts.collect()}  # as many as the pattern has
        return sorted(((g, found.get(g, 0), k) for g, k in wanted.items()), key=lambda x: (x[1], x[0]))[:most]

    def candidates(self, grams: list[tuple[str, int, int]]) -> DataFrame:
        """Ids of the rows that have all these trigrams."""
        hit = self._read("postings", f"gram string, id {self.rows.schema['id'].dataType.simpleString()}", sorted({k for _, _, k in grams}))
        some = hit.where(F.col("gram").isin([g for g, _, _ in grams]))
        return some.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")

    def search(self, pattern: str) -> DataFrame:
        """(id, text) of the rows whose text is like ``pattern``, upper and lower case alike."""
        grams = self.rarest(pattern)
        if grams is None:
            return self.rows.where(F.col("text").ilike(pattern))
        if not grams[0][1]:
            return self.rows.where("false")
        return self.rows.join(self.candidates(grams), "id", "left_semi").where(F.col("text").ilike(pattern))


def _folder(gram: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(folders)).cast("int")


def build(rows: DataFrame, *, folders: int = FOLDERS) -> TrigramIndex:
    """Index ``rows`` (id, text); ids tell rows apart."""
    path = f"{shared_dir(rows.sparkSession)}/kindred/trigrams-{uuid.uuid4().hex}"
    spark = rows.sparkSession
    rows.select("id", "text").write.parquet(f"{path}/rows")
    stored = spark.read.schema(rows.select("id", "text").schema).parquet(f"{path}/rows")
    postings = stored.select(F.explode(_grams(F.col("text"))).alias("gram"), "id").withColumn("_folder", _folder(F.col("gram"), folders))
    # Frequent trigrams are spread by their rows, so no task gets one whole; parts and tasks follow the rows, so none grows with them.
    n = stored.count()
    part = F.pmod(F.xxhash64("id"), F.lit(max(DEAL, -(-n // DEAL_ROWS))))
    dealt = postings.repartition(max(1, -(-n * TASKS_A_PART // DEAL_ROWS)), F.col("_folder"), part).sortWithinPartitions("_folder", "gram")
    dealt.write.partitionBy("_folder").parquet(f"{path}/postings")
    counts = postings.groupBy("gram", "_folder").agg(F.count("*").alias("n"))
    counts.repartition("_folder").sortWithinPartitions("_folder", "gram").write.partitionBy("_folder").parquet(f"{path}/counts")
    for kind in ("postings", "counts"):
        _complete(spark, f"{path}/{kind}", folders)
    return TrigramIndex(spark, path, stored, folders)


def _complete(spark: SparkSession, path: str, folders: int) -> None:
    """Folders without rows are there too, so that any can be read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for k in range(folders):
        files.mkdirs(hadoop.Path(f"{path}/_folder={k}"))
