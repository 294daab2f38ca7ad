"""A prefix trie of conversations, merged family by family.

A family is the conversations of one base id, ``conv_id - conv_id % 20``.  One
shuffle brings a family's turns together (digest and word count of a turn, no
text).  There every conversation is rebuilt: it begins with the first turns of
the family's base conversation, how many tells ``crc32(conv_id) % 4``, and goes
on with its own later turns.  A node's key is the XOR of its turns' hashes with
their places (128 bits), a running value along the conversation.  The family's
small trie is one row for each of its keys with the (at most 39) members there.

Only these combined nodes leave the family.  Nodes of several families meet by
key and learn their smallest member and whether they are leaves.  Back on
their members' paths, every distinct node counts once, on its smallest
member's path: below a node, the nodes of a path that the same conversation
owns are a suffix of it, so children, leaves and distinct words of all subtrees
are running sums along paths, and a last grouping by key adds them up.  All groupings
combine before they shuffle, so the root and frequent first turns are one row a task.

Digests of long lists of members come in order from chunks of ``CHUNK``
families: SHA-256 takes a list from its beginning, so one task reads a node's
chunks in turn and holds one of them.

Defined results: rows without a conv_id are left out; null role or text is
empty; turns with an equal number are ordered by their digest; repeated rows
are repeated turns; an empty table has no node, not even a root.  Long
conversations are sorted and spilled by Spark, never held whole; long texts are
read once, where they are stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from kindred.storage import materialise

FAMILY = 20
LENT = 4  # a conversation takes fewer turns than this from its base
CHUNK = 1000
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["_k1", "_k2"]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every rebuilt conversation's turns and its root (place 0), dealt out by family."""
    conv = F.col("conv_id").cast("bigint")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        (conv - conv % FAMILY).alias("_base"),
        conv.alias("_conv"),
        F.col("turn").alias("_turn"),
        F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("_digest"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("_words"),
    )
    family, own = Window.partitionBy("_base"), Window.partitionBy("_base", "_conv").orderBy(F.col("_turn").asc_nulls_first(), "_digest")
    numbered = turns.repartition("_base").withColumn("_at", F.row_number().over(own))
    first = F.when((F.col("_conv") == F.col("_base")) & (F.col("_at") < LENT), F.struct("_at", "_digest", "_words"))
    headed = numbered.withColumn("_heads", F.sort_array(F.collect_list(first).over(family))).withColumn("_h", (F.crc32(F.col("_conv").cast("string")) % LENT).cast("int"))
    lent = F.least("_h", F.size("_heads"))
    turn = lambda place, digest, words: F.struct(place.cast("int").alias("place"), digest.alias("digest"), words.cast("bigint").alias("words"))
    none = F.expr("cast(array() as array<struct<place:int,digest:binary,words:bigint>>)")
    kept = F.when(F.col("_at") > F.col("_h"), F.array(turn(lent + F.col("_at") - F.col("_h"), F.col("_digest"), F.col("_words")))).otherwise(none)
    root = F.array(turn(F.lit(0), F.lit(b""), F.lit(0)))
    begun = F.when(F.col("_at") == 1, F.concat(root, F.transform(F.slice("_heads", 1, lent), lambda x: turn(x["_at"], x["_digest"], x["_words"])))).otherwise(none)
    return headed.select("_base", "_conv", F.explode(F.concat(begun, kept)).alias("t")).select("_base", "_conv", F.col("t.place").alias("_place"), F.col("t.digest").alias("_digest"), F.col("t.words").alias("_words"))


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The tries of all families: key, depth, words, members, ends, words of all members below."""
    path, whole = Window.partitionBy("_base", "_conv").orderBy("_place"), Window.partitionBy("_base", "_conv")
    up_to = path.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = rebuilt(conversations).select(
        "_base",
        "_conv",
        "_place",
        "_words",
        F.bit_xor(F.xxhash64("_digest", "_place")).over(up_to).alias("_k1"),
        F.bit_xor(F.xxhash64("_place", "_digest")).over(up_to).alias("_k2"),
        (F.sum("_words").over(whole) - F.sum("_words").over(up_to) + F.col("_words")).alias("_below"),
        F.lead("_place").over(path).isNull().alias("_last"),
    )
    return walked.groupBy("_base", *KEY).agg(
        F.max("_place").alias("_depth"),
        F.max("_words").alias("_words"),
        F.sum("_below").alias("_below"),
        F.sort_array(F.collect_list("_conv")).alias("_members"),
        F.sort_array(F.collect_list(F.when(F.col("_last"), F.col("_conv")))).alias("_ends"),
    )


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks of ids to one digest for each key."""
    key, sha = None, hashlib.sha256()

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"_k1": pa.array([r[0] for r in rows], pa.int64()), "_k2": pa.array([r[1] for r in rows], pa.int64()), "ends_sha256": pa.array([r[2] for r in rows], pa.string())})

    for batch in batches:
        done = []
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "_ids")), strict=True):
            if (k1, k2) != key:
                if key:
                    done.append((*key, sha.hexdigest()))
                key, sha = (k1, k2), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield made(done)
    if key:
        yield made([(*key, sha.hexdigest())])


def end_digests(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """SHA-256 of the ascending ids that end at each node where any do.

    Families are intervals of ids, so families in order give ids in order.
    """
    some = nodes.where(F.size("_ends") > 0).select(*KEY, F.floor(F.col("_base") / (FAMILY * chunk)).alias("_chunk"), F.struct("_base", "_ends").alias("_part"))
    ids = F.flatten(F.transform(F.sort_array(F.collect_list("_part")), lambda p: p["_ends"]))
    chunks = some.groupBy(*KEY, "_chunk").agg(F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("_ids"))
    ordered = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "_chunk").select(*KEY, "_ids")
    return ordered.mapInArrow(_hash_chunks, "_k1 long, _k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """One row for each node of the trie of all rebuilt conversations."""
    nodes = materialise(family_nodes(conversations), "family_nodes")
    met = nodes.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.col("_members")[0]).alias("_owner"), (F.sum(F.size("_members")) == F.sum(F.size("_ends"))).alias("_leaf"))
    shared = met.where("n > 1").drop("n")
    local = nodes.select("_base", *KEY, "_depth", "_words", "_below", "_members", (F.size("_members") == F.size("_ends")).alias("_ended"))
    member = local.join(shared, KEY, "left").select(
        "_base",
        *KEY,
        "_depth",
        "_words",
        "_below",
        F.coalesce("_owner", F.col("_members")[0]).alias("_owner"),
        F.coalesce("_leaf", "_ended").alias("_leaf"),
        F.posexplode("_members").alias("_nth", "_conv"),
    )
    path, whole = Window.partitionBy("_base", "_conv").orderBy("_depth"), Window.partitionBy("_base", "_conv")
    up_to = path.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("_conv") == F.col("_owner")
    suffix = lambda c: F.sum(c).over(whole) - F.sum(c).over(up_to) + F.col(c)
    summed = (
        member.select("_base", "_conv", *KEY, "_depth", "_owner", F.when(F.col("_nth") == 0, F.col("_below")).otherwise(0).alias("_below"), own.cast("bigint").alias("_own"), F.when(own, F.col("_words")).otherwise(0).alias("_own_words"), (own & F.col("_leaf")).cast("bigint").alias("_own_leaf"))
        .select(*KEY, "_depth", "_owner", "_below", suffix("_own_words").alias("_distinct"), suffix("_own_leaf").alias("_leaves"), F.lead("_own", 1, 0).over(path).alias("_child"), F.lag("_owner").over(path).alias("_parent"))
        .groupBy(*KEY)
        .agg(F.min("_owner").alias("conv_id"), F.max("_depth").cast("bigint").alias("depth"), F.max("_parent").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum("_child").alias("n_children"), F.sum("_leaves").alias("n_leaves"), (F.sum("_below") - F.sum("_distinct")).alias("saved_tokens"))
    )
    return summed.join(end_digests(nodes, chunk), KEY, "left").drop(*KEY).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the whole conversations table."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: DuckDB's crc32 of a list of byte values, bit by bit.
CRC32 = "xor(list_reduce(list_concat([4294967295::UBIGINT], {}), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x // 2, 3988292384::UBIGINT * (x % 2)))), 4294967295::UBIGINT)"

OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {CRC32.format("list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)")} % 4 AS h FROM turns
), pieces AS (
  SELECT c.conv_id, 0 AS part, k, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND k > h
), built AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY part, k) AS s FROM pieces GROUP BY conv_id
), complete AS (
  SELECT c.conv_id, coalesce(s, []) AS s FROM convs c LEFT JOIN built b ON c.conv_id = b.conv_id
), nodes AS (
  SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len(s) = d) AS ends
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM complete) GROUP BY ALL
), children AS (
  SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), worth AS (
  SELECT x.p, x.d, (CASE WHEN x.d > 0 THEN (x.n - 1) * len(regexp_extract_all(x.p[x.d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END)::BIGINT AS saved, (c.n IS NULL)::BIGINT AS leaf
  FROM nodes x LEFT JOIN children c ON x.p = c.p
), below AS (
  SELECT p[1:up] AS p, sum(saved)::BIGINT AS saved, sum(leaf)::BIGINT AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM worth) GROUP BY ALL
)
SELECT x.conv_id, x.d AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM nodes x JOIN below b ON x.p = b.p LEFT JOIN children c ON x.p = c.p LEFT JOIN nodes up ON x.d > 0 AND up.p = x.p[1:x.d - 1]
"""
