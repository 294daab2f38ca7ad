"""Secret scans over an incremental ledger of blobs.

A blob is a text addressed by its SHA-256, so every version of every path is
one row of (path, blob) and equal texts are one blob.  The ledger is a folder of
Parquet batches in the shared storage: a row says which rule versions a blob
has been scanned with and what they found.  A scan takes the distinct blobs of
all versions, subtracts the ledger's (blob, rule version) pairs, reads only the
texts that are left (one for each blob, copies merge before the shuffle), appends
one batch and joins the findings of the current rule versions back to all paths.

A batch counts only when its writer has finished (``_SUCCESS``), so a lost
driver leaves the ledger as it was; rows are facts about contents, so a batch
that is written twice changes nothing.

All of it is DataFrame functions.  Positions come from splitting a text at a
rule's matches: the lengths of pieces and matches, summed in blocks of
``BLOCK`` matches, give every span in code points in linear time.

Defined results: a null text is an empty one, which is a blob without findings;
repeated rows and ties are separate versions of one blob and get the same
findings; an empty table gives an empty result; other columns stay with their
row under any name.  Texts are scanned whole whatever their length, and no rule
backtracks over more than one run of its own characters.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from kindred.storage import shared_dir

BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, then formats of keys that their issuers publish. A run of at least n characters is what
# is left of a maximal run's matches once those of fewer are dropped; `assign` keeps short ones until its end, since they
# cover text in which another match could begin.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
)
RULES = BASE + ADDED

SPANS = "array<struct<kind:string,version:int,start:bigint,end:bigint>>"
LEDGER = f"blob binary, scanned array<string>, found {SPANS}"


def blob(text: Column) -> Column:
    """The content address of a text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class Ledger:
    """Scanned (blob, rule version) pairs and their findings in one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/kindred/ledger-{uuid.uuid4().hex}"

    def batches(self) -> list[str]:
        """Folders of the finished batches."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        store = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(top):
            return []
        there = (s.getPath() for s in store.listStatus(top) if s.isDirectory())
        return sorted(p.toString() for p in there if store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def rows(self) -> DataFrame:
        found = self.batches()
        return self.spark.read.schema(LEDGER).parquet(*found) if found else self.spark.createDataFrame([], LEDGER)

    def append(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")


def _running(steps: Column) -> Column:
    """Spans of ``steps`` (gap before a match, its length, its value's length), in order."""

    def block(i: Column) -> Column:
        return F.aggregate(
            F.slice(steps, i * BLOCK + 1, BLOCK),
            F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:bigint>>)").alias("out")),
            lambda a, s: F.struct(
                (a["at"] + s["gap"] + s["size"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["size"]).alias("end"), s["value"].alias("value")))).alias("out"),
            ),
        )

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), block)
    moved = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<array<struct<start:bigint,end:bigint,value:bigint>>>)").alias("out")),
        lambda a, b: F.struct(
            (a["at"] + b["at"]).alias("at"),
            F.concat(a["out"], F.array(F.transform(b["out"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), (s["end"] + a["at"]).alias("end"), s["value"].alias("value"))))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.flatten(moved)


def spans(text: Column, rule: Rule) -> Column:
    """The rule's spans in a text, leftmost and without overlap, short ones dropped."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sizes = F.transform(whole, F.char_length)
    values = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.char_length) if rule.group else sizes
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    steps = F.zip_with(F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("gap"), sizes.alias("size")), values, lambda s, v: F.struct(s["gap"].cast("bigint").alias("gap"), s["size"].cast("bigint").alias("size"), v.cast("bigint").alias("value")))
    kept = F.filter(_running(steps), lambda s: s["value"] >= rule.least)
    named = F.transform(kept, lambda s: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when(text.rlike(rule.pattern), named).otherwise(F.expr(f"cast(array() as {SPANS})"))


def scan(versions: DataFrame, ledger: Ledger, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows of ``versions`` with ``_blob`` and ``_found``, the findings of ``rules``.

    Scans what the ledger lacks and appends it.  The result reads the ledger's
    batches of this moment.
    """
    keys = F.array(*(F.lit(r.key) for r in rules))
    packed = versions.select(F.struct(*(F.col(f"`{c}`") for c in versions.columns)).alias("_row"), F.col(f"`{text}`").alias("_text"), blob(F.col(f"`{text}`")).alias("_blob"))
    texts = packed.groupBy("_blob").agg(F.any_value(F.coalesce("_text", F.lit(""))).alias("_text"))
    if ledger.batches():
        seen = ledger.rows().groupBy(F.col("blob").alias("_blob")).agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("_seen"))
        left = packed.select("_blob").distinct().join(seen, "_blob", "left").select("_blob", F.array_except(keys, F.coalesce("_seen", F.expr("cast(array() as array<string>)"))).alias("_todo")).where(F.size("_todo") > 0)
        # The semi join moves below the grouping when few blobs are left: only their texts are shuffled then.
        todo = texts.join(left.select("_blob"), "_blob", "left_semi").join(left, "_blob")
    else:
        todo = texts.withColumn("_todo", keys)
    none = F.expr(f"cast(array() as {SPANS})")
    found = F.concat(*(F.when(F.array_contains("_todo", r.key), spans(F.col("_text"), r)).otherwise(none) for r in rules))
    ledger.append(todo.select(F.col("_blob").alias("blob"), F.col("_todo").alias("scanned"), found.alias("found")))
    current = F.filter("found", lambda s: F.array_contains(keys, F.concat(s["kind"], F.lit("@"), s["version"].cast("string"))))
    findings = ledger.rows().where(F.size("found") > 0).groupBy(F.col("blob").alias("_blob")).agg(F.array_distinct(F.flatten(F.collect_list(current))).alias("_found"))
    return packed.join(findings, "_blob", "left").select("_row.*", "_blob", F.coalesce("_found", none).alias("_found"))


def joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    """``kind:start:end`` of the rules' spans by start, then kind as listed, comma-joined."""
    place = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    own = F.filter(found, lambda s: s["kind"].isin([r.kind for r in rules]))
    ordered = F.array_sort(F.transform(own, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, through a ledger that starts empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, Ledger(spark)).select("doc_id", F.col("_found").alias("f"))
    count = lambda kind: F.size(F.filter("f", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(joined(F.col("f"), BASE), 256).alias("base_sha256"), joined(F.col("f"), RULES).alias("spans"))


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def matches(place: int, r: Rule) -> str:
        p = quoted(r.pattern)
        return f"""SELECT n, {place} AS place, {quoted(r.kind)} AS kind, {r.least} AS least,
       unnest(list_transform(regexp_split_to_array(text, {p})[:-2], lambda x: length(x))) AS gap,
       unnest(list_transform(regexp_extract_all(text, {p}), lambda x: length(x))) AS size,
       unnest(list_transform(regexp_extract_all(text, {p}, {r.group}), lambda x: length(x))) AS val,
       generate_subscripts(regexp_extract_all(text, {p}), 1) AS pos
FROM docs WHERE regexp_matches(text, {p})"""

    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents
), matched AS (
{" UNION ALL ".join(matches(i, r) for i, r in enumerate(RULES))}
), placed AS (
  SELECT *, sum(gap + size) OVER (PARTITION BY n, place ORDER BY pos) AS stop FROM matched
), spans AS (
  SELECT n, place, kind, stop - size AS start, kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT AS span FROM placed WHERE val >= least
)
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (place < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, place), '') AS spans
FROM docs d LEFT JOIN spans s ON d.n = s.n GROUP BY d.n
"""


OP11_SQL = _sql()
