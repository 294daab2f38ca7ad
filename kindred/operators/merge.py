"""Merging the groups of several hash algorithms."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from kindred.operators.components import connected_components


def at_least_two(labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(id, label) of groups with two members or more; the label is the least id."""
    keys = keys or ["label"]
    sizes = labels.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("id").alias("_least")).where(F.col("_n") >= 2)
    return labels.join(sizes, keys).select("id", F.col("_least").alias("label"))


def merge_union(groups: list[DataFrame]) -> DataFrame:
    """Closure of all groups of all algorithms."""
    edges = reduce(DataFrame.unionByName, (g.where(F.col("id") != F.col("label")).select(F.col("id").alias("src"), F.col("label").alias("dst")) for g in groups))
    return at_least_two(connected_components(edges).select("id", F.col("component").alias("label")))


def merge_edges(edges: list[DataFrame]) -> DataFrame:
    """The union of all algorithms' groups straight from their edges (src, dst): one run of components."""
    return at_least_two(connected_components(reduce(DataFrame.unionByName, edges)).select("id", F.col("component").alias("label")))


def merge_intersection(groups: list[DataFrame]) -> DataFrame:
    """Items that every algorithm puts into one group together.

    Being together in all algorithms is an equivalence, so the tuple of labels
    names the merged group and nothing needs to iterate.
    """
    named = [g.select("id", F.col("label").alias(f"label_{k}")) for k, g in enumerate(groups)]
    joined = reduce(lambda a, b: a.join(b, "id"), named)
    return at_least_two(joined, [f"label_{k}" for k in range(len(groups))])


def merge_groups(groups: list[DataFrame], strategy: str) -> DataFrame:
    """Dispatch; a single algorithm only loses its single items."""
    if not groups:
        raise ValueError("no groups to merge")
    if len(groups) == 1:
        return at_least_two(groups[0])
    return {"union": merge_union, "intersection": merge_intersection}[strategy](groups)
