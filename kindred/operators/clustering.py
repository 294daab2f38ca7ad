"""Verification of candidate groups: bounded pair scores and order-dependent complete-link clusters.

``first_fit`` puts every item, in order, into the first cluster whose every
member it is linked with.  Groups of at most ``SMALL`` members fold over their
sorted items inside one expression.  Larger ones of a verifier that can test
arrays go block by block (``firstfit``); where only their links are given, they
decide in rounds of joins, in which many items decide at once and no task holds
a group:

* a cluster is named by its first member, so the order of clusters is known;
* an item is a candidate of a cluster while it is linked with all its members;
* an undecided item without candidates and without undecided earlier neighbours
  begins a cluster;
* it joins its earliest candidate cluster if no undecided neighbour is earlier
  than that cluster's first member (it might begin an earlier one) and it is
  linked with every earlier undecided candidate (none of them can shut it out).

A later item may join before an earlier candidate decides, but then the two are
linked, so being linked with all members is the sequential test.  The earliest
undecided item always decides; rounds are as many as the longest chain of
decisions that wait for each other.

Equal rasters are one class: the first of them decides for all, since copies
have the same links and are linked with each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from kindred.operators.firstfit import Links, first_fit
from kindred.storage import discard, materialise

SMALL = 200


@dataclass(frozen=True)
class Verifier:
    """A pair score and its test, with what can be told without the score.

    ``features`` makes a small struct of a raster, ``possible`` tells from two
    of them whether the pair can pass, ``bands`` are numbers of a struct that
    differ by at most a width in every pair that passes.  ``links`` is the test
    of many rasters with many others in arrays, exactly as score and test.
    """

    score: Callable[[Column, Column], Column]
    accepts: Callable[[Column], Column]
    features: Callable[[Column], Column] | None = None
    possible: Callable[[Column, Column], Column] | None = None
    bands: tuple[tuple[Callable[[Column], Column], float], ...] = ()
    links: Links | None = None


def group_pairs(members: DataFrame, score: Callable[[Column, Column], Column], keys: list[str]) -> DataFrame:
    """Scores of all pairs (i before j) inside each candidate group."""
    a = members.select(*keys, F.col("seq").alias("i"), F.col("grey").alias("grey_i"))
    b = members.select(*keys, F.col("seq").alias("j"), F.col("grey").alias("grey_j"))
    return a.join(b, keys).where(F.col("i") < F.col("j")).select(*keys, "i", "j", score(F.col("grey_i"), F.col("grey_j")).alias("score"))


def classes(members: DataFrame, verifier: Verifier, keys: list[str]) -> DataFrame:
    """keys, seq, grey and first: the first member with the same raster, if copies pass the test."""
    own = F.coalesce(verifier.accepts(verifier.score(F.col("grey"), F.col("grey"))), F.lit(False))
    equal = members.groupBy(*keys, "grey").agg(F.min("seq").alias("_first"), F.count("*").alias("_n"))
    equal = equal.withColumn("_own", F.when(F.col("_n") == 1, True).otherwise(own)).drop("_n")
    return members.join(equal, [*keys, "grey"]).select(*keys, "seq", "grey", F.when(F.col("_own"), F.col("_first")).otherwise(F.col("seq")).alias("first"))


def _met(items: DataFrame, verifier: Verifier, keys: list[str], *carried: str) -> DataFrame:
    """Pairs that features cannot rule out, with ``carried`` columns of both sides (_i and _j at their ends).

    One join on the group and the first band: a pair is never shuffled, only
    items are, one of the sides three times.
    """
    known = items.select(*keys, "seq", *carried, (verifier.features(F.col("grey")) if verifier.features else F.lit(0)).alias("f"))
    side = lambda rows, s: rows.select(*keys, *cells, F.col("seq").alias(s), F.col("f").alias(f"f_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in carried))
    cells: list[str] = []
    other = known
    if verifier.bands:
        number, width = verifier.bands[0]
        cells = ["_band"]
        known = known.withColumn("_band", F.floor(number(F.col("f")) / width))
        other = known.withColumn("_band", F.explode(F.sequence(F.col("_band") - 1, F.col("_band") + 1)))  # within a width: this band or the next
    near = reduce(lambda c, x: c & (F.abs(x[0](F.col("f_i")) - x[0](F.col("f_j"))) <= x[1]), verifier.bands, F.col("i") < F.col("j"))
    met = side(known, "i").join(side(other, "j"), [*keys, *cells]).where(near)
    return met.where(verifier.possible(F.col("f_i"), F.col("f_j"))) if verifier.possible else met


def candidate_pairs(items: DataFrame, verifier: Verifier, keys: list[str]) -> DataFrame:
    """keys, i, j of pairs that features cannot rule out; all pairs without features."""
    return _met(items, verifier, keys).select(*keys, "i", "j")


def linked_pairs(items: DataFrame, verifier: Verifier, keys: list[str]) -> DataFrame:
    """keys, i, j of pairs that pass; only candidates are scored."""
    met = _met(items, verifier, keys, "grey")
    return met.where(verifier.accepts(verifier.score(F.col("grey_i"), F.col("grey_j")))).select(*keys, "i", "j")


def _folded(members: DataFrame, links: DataFrame) -> DataFrame:
    """First fit of groups whose members fit one row: _g, seq, cluster."""
    before = links.groupBy("_g", F.col("j").alias("seq")).agg(F.collect_list("i").alias("before"))
    rows = members.join(before, ["_g", "seq"], "left").groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("before", F.array().cast("array<bigint>")).alias("before")))).alias("items"))
    home = lambda found, x: F.array_position(F.transform(found, lambda c: F.forall(c, lambda y: F.array_contains(x["before"], y))), True)
    none = F.array().cast("array<array<bigint>>")

    def put(found: Column, x: Column) -> Column:
        place = home(found, x)
        grown = F.transform(found, lambda c, k: F.when(k + 1 == place, F.array_append(c, x["seq"])).otherwise(c))
        return F.when(place > 0, grown).otherwise(F.array_append(found, F.array(x["seq"])))

    found = rows.select("_g", F.posexplode(F.aggregate("items", none, put)).alias("cluster", "_c"))
    return found.select("_g", F.explode("_c").alias("seq"), "cluster")


def _round(now: DataFrame, links: DataFrame) -> DataFrame:
    """One round over _g, seq, seed (null: undecided)."""
    undecided = now.where(F.col("seed").isNull()).select("_g", "seq")
    done = now.where(F.col("seed").isNotNull())
    both = links.select("_g", F.col("i").alias("seq"), F.col("j").alias("other")).unionByName(links.select("_g", F.col("j").alias("seq"), F.col("i").alias("other")))
    waiting = both.join(undecided, ["_g", "seq"])
    met = waiting.join(done.select("_g", F.col("seq").alias("other"), "seed"), ["_g", "other"]).groupBy("_g", "seq", "seed").agg(F.count("*").alias("n"))
    sizes = done.groupBy("_g", "seed").agg(F.count("*").alias("n"))
    candidates = met.join(sizes, ["_g", "seed", "n"]).select("_g", "seq", "seed")
    earliest = waiting.join(undecided.select("_g", F.col("seq").alias("other")), ["_g", "other"]).groupBy("_g", "seq").agg(F.min("other").alias("least"))
    first = candidates.groupBy("_g", "seq").agg(F.min("seed").alias("seed"))
    # How many earlier candidates of the same cluster there are, and how many of them are linked.
    rank = candidates.withColumn("ahead", F.row_number().over(Window.partitionBy("_g", "seed").orderBy("seq")) - 1)
    pairs = links.join(candidates.select("_g", F.col("seq").alias("i"), "seed"), ["_g", "i"]).join(candidates.select("_g", F.col("seq").alias("j"), "seed"), ["_g", "j", "seed"])
    held = pairs.groupBy("_g", F.col("j").alias("seq"), "seed").agg(F.count("*").alias("held"))
    free = first.join(rank, ["_g", "seq", "seed"]).join(held, ["_g", "seq", "seed"], "left").where(F.col("ahead") == F.coalesce("held", F.lit(0)))
    joins = free.join(earliest, ["_g", "seq"], "left").where(F.col("least").isNull() | (F.col("least") > F.col("seed"))).select("_g", "seq", "seed")
    later = earliest.where(F.col("least") < F.col("seq")).select("_g", "seq")
    begins = undecided.join(first.select("_g", "seq"), ["_g", "seq"], "left_anti").join(later, ["_g", "seq"], "left_anti").select("_g", "seq", F.col("seq").alias("seed"))
    fresh = joins.unionByName(begins).withColumnRenamed("seed", "_new")
    return now.join(fresh, ["_g", "seq"], "left").select("_g", "seq", F.coalesce("seed", "_new").alias("seed"))


def _in_rounds(members: DataFrame, links: DataFrame) -> DataFrame:
    """First fit of groups of any size: _g, seq, cluster."""
    now, near = materialise(members.withColumn("seed", F.lit(None).cast("bigint")), "undecided"), materialise(links, "links")
    while not now.where(F.col("seed").isNull()).isEmpty():
        after = materialise(_round(now, near), "undecided")
        discard(now)
        now = after
    discard(near)
    return _numbered(now)


def _numbered(now: DataFrame) -> DataFrame:
    """_g, seq, cluster: clusters in the order of their seeds."""
    seeds = now.where(F.col("seq") == F.col("seed")).select("_g", "seed")
    numbered = seeds.withColumn("cluster", F.row_number().over(Window.partitionBy("_g").orderBy("seed")) - 1)
    return now.join(numbered, ["_g", "seed"]).select("_g", "seq", "cluster")


def greedy_clusters(members: DataFrame, accepted: DataFrame, keys: list[str], *, small: int = SMALL) -> DataFrame:
    """keys, seq and cluster, the number of a member's cluster inside its group.

    ``accepted`` holds the pairs (keys, i, j) with i before j that pass.
    Groups of more than ``small`` members go through the rounds.
    """
    group = F.struct(*keys).alias("_g")
    items = members.select(group, F.col("seq").cast("bigint").alias("seq"))
    links = accepted.select(group, F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"))
    large = materialise(items.groupBy("_g").agg(F.count("*").alias("n")).where(F.col("n") > small).select("_g"), "large_groups")
    if large.isEmpty():
        found = _folded(items, links)
    else:
        found = _folded(items.join(large, "_g", "left_anti"), links.join(large, "_g", "left_anti"))
        found = found.unionByName(_in_rounds(items.join(large, "_g", "left_semi"), links.join(large, "_g", "left_semi")))
    return found.select("_g.*", "seq", F.col("cluster").cast("int").alias("cluster"))


def clustered(members: DataFrame, verifier: Verifier, keys: list[str], *, small: int = SMALL) -> DataFrame:
    """keys, seq and cluster of a group's members under one verifier, copies counted once."""
    known = materialise(classes(members, verifier, keys), "classes")
    items = known.where(F.col("seq") == F.col("first")).select(*keys, "seq", "grey")
    large = materialise(items.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > small).select(*keys), "large_groups") if verifier.links else None
    some = large is not None and not large.isEmpty()
    few = materialise(items.join(large, keys, "left_anti"), "few") if some else items  # stored, or features of all are worked out
    links = materialise(linked_pairs(few, verifier, keys), "links")
    found = greedy_clusters(few, links, keys, small=small)
    if some:
        many = items.join(large, keys, "left_semi").select(F.struct(*keys).alias("_g"), F.col("seq").cast("bigint").alias("seq"), "grey")
        found = found.unionByName(_numbered(first_fit(many, verifier.links)).select("_g.*", "seq", F.col("cluster").cast("int").alias("cluster")))
    return known.select(*keys, "seq", "first").join(found.withColumnRenamed("seq", "first"), [*keys, "first"]).select(*keys, "seq", "cluster")


def verify(members: DataFrame, verifiers: list[Verifier | tuple], *, small: int = SMALL) -> DataFrame:
    """Refine groups by each verifier in turn; clusters below two members go.

    A verifier without bounds may be a tuple (score, test).  ``members`` has group_id, seq and grey.  The result has group_id, seq, grey
    and cluster columns c0, c1, ...
    """
    keys, now = ["group_id"], members.select("group_id", "seq", "grey")
    for k, verifier in enumerate(verifiers):
        verifier = verifier if isinstance(verifier, Verifier) else Verifier(*verifier)
        found = clustered(now, verifier, keys, small=small).withColumnRenamed("cluster", f"c{k}")
        now = now.join(found, [*keys, "seq"])
        keys = [*keys, f"c{k}"]
        big = now.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= 2).drop("_n")
        now = now.join(big, keys, "left_semi")
    return now
