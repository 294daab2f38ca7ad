"""The operators as filters over documents: each returns the columns it got."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from kindred.llm import decontaminate, line_dedup, packing, parity_join, toxicity
from kindred.storage import materialise

TEXT = ("doc_id", "text")
NEAR_SHINGLE = 5
NEAR_SIMILARITY = (80, 100)
BROADCAST_ROWS = 250_000  # of two numbers each


def pack_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in a struct, out of the way of added names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in TEXT]
    return docs.select(*TEXT, F.struct(F.lit(0).alias("_"), *others).alias("_rest"))


def unpack_columns(packed: DataFrame, columns: list[str]) -> DataFrame:
    return packed.select(*(F.col(c) if c in TEXT else F.col(f"_rest.`{c}`").alias(c) for c in columns))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = toxicity.CUT) -> DataFrame:
    """Documents that score below ``cut`` under a model of all their labels."""
    weights, intercept = toxicity.train(docs, labels)
    scored = toxicity.score(pack_columns(docs), weights, intercept, keep=(*TEXT, "_rest"))
    return unpack_columns(scored.where(F.col("score") < cut), docs.columns)


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """Documents without their repeated lines; a column n_chars follows the text.

    All documents stay, texts that lose all lines as empty ones; a null text
    becomes empty.
    """
    made = line_dedup.dedup_lines(pack_columns(docs), keep=("_rest",), **options)
    out = unpack_columns(made.select("doc_id", F.col("kept_text").alias("text"), "_rest"), docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_copies(docs: DataFrame, *, shingle: int = NEAR_SHINGLE, similarity: tuple[int, int] = NEAR_SIMILARITY) -> DataFrame:
    """One document of every group: that of the smallest id, ties by the text's hash.

    A document is its id and text, so rows that share an id but not a text are
    judged one by one; of rows equal in both one stays, the one whose other
    columns hash lowest.  Texts without words and rows without an id stay.
    """
    known = F.xxhash64(F.coalesce("text", F.lit("")))
    found = parity_join.jaccard_components(docs.select(*TEXT, known.alias("_text")), shingle=shingle, similarity=similarity, keep=("_text",))
    rows = materialise(found.where(F.col("first").isNotNull()).groupBy("doc_id", "_text").agg(F.min("first").alias("first"), F.count("*").alias("n")), "groups")
    lost, repeated = rows.where(~F.col("first")).select("doc_id", "_text"), rows.where(F.col("first") & (F.col("n") > 1)).select("doc_id", "_text")
    n_lost, n_repeated = rows.agg(F.count_if(~F.col("first")), F.count_if(F.col("first") & (F.col("n") > 1))).first()
    few = lambda some, n: F.broadcast(some) if n <= BROADCAST_ROWS else some
    packed = pack_columns(docs).select(*TEXT, "_rest", known.alias("_text"))
    kept = packed.join(few(lost, n_lost), ["doc_id", "_text"], "left_anti") if n_lost else packed
    if n_repeated:
        again = kept.join(few(repeated, n_repeated), ["doc_id", "_text"], "left_semi")
        one = again.groupBy("doc_id", "_text").agg(F.min_by(F.struct("text", "_rest"), F.xxhash64("_rest")).alias("_one"))
        kept = kept.join(few(repeated, n_repeated), ["doc_id", "_text"], "left_anti").select(*TEXT, "_rest").unionByName(one.select("doc_id", "_one.text", "_one._rest"))
    return unpack_columns(kept, docs.columns)


def drop_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    marked = decontaminate.scan(pack_columns(docs), items, keep=("text", "_rest"), **options)
    return unpack_columns(marked.where(~F.col("contaminated")), docs.columns)


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The packed pieces of all documents."""
    return packing.pack_documents(docs, tokenizer_path)
