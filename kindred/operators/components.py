"""Connected components of an edge table, by alternating star contraction.

Large-star and small-star steps (Kiveris et al., "Connected components in
MapReduce and beyond", 2014) point every vertex at ever smaller vertices of its
component.  Each step is a grouped minimum and an equi-join, the edge count
never grows, and chains shrink in a logarithmic number of rounds.  A round
shuffles six times, so whether there is one more to do is read from the edges.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from kindred.storage import discard, materialise

MAX_ROUNDS = 60


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over directed (u, v) pairs: neighbours move to the least one.

    Hot vertices do not gather lists: the minimum is a partial aggregate and
    the rest is an equi-join that Spark can split.
    """
    if small:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u")
    if small:
        kept = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        kept = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = kept.where(F.col("u") != F.col("v"))
    return kept.distinct() if small else kept  # the next small star takes away what is equal


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex points at one root and no root points on: no step would change that."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("come")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("come")))
    of_id = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("come").alias("come"))
    return not of_id.agg(F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("come") > 0)))).first()[0]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): the least vertex reachable, for every vertex of an edge.

    Self-loops and null ends are ignored; an empty table gives an empty result.
    """
    now = materialise(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        before, now = now, materialise(_star(_star(now, small=False), small=True), "edges")
        discard(before)
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
