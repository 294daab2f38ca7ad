"""The near-duplicate scan: hash, group, merge, verify, rate, choose a master."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from kindred.catalog import rollup
from kindred.operators import bounds, clustering, hashing
from kindred.operators.hamming import hash_groups, hash_groups_of, union_edges
from kindred.operators.merge import at_least_two, merge_edges, merge_groups
from kindred.storage import materialise


@dataclass(frozen=True)
class HashAlgorithm:
    id: str
    name: str
    default_threshold: float
    expression: Callable[[Column], Column]  # grey values to a 64-bit hash


@dataclass(frozen=True)
class VerifyAlgorithm:
    id: str
    name: str
    default_threshold: float
    at_least: bool  # the score must reach the threshold, not stay below it
    score: Callable[[Column, Column], Column]  # of two rasters
    bounded: Callable[[float], clustering.Verifier] | None = None  # with bounds, for a threshold


@dataclass(frozen=True)
class Preset:
    hash_algorithms: tuple[str, ...]
    hash_thresholds: dict[str, int]
    merge_strategy: str
    verify_algorithms: tuple[str, ...]
    verify_thresholds: dict[str, float]
    extra: dict[str, int] = field(default_factory=dict, compare=False)


HASHES: dict[str, HashAlgorithm] = {}
VERIFIERS: dict[str, VerifyAlgorithm] = {}


def register(algorithm: HashAlgorithm | VerifyAlgorithm) -> None:
    """Add an algorithm; a later one of the same id replaces it."""
    (HASHES if isinstance(algorithm, HashAlgorithm) else VERIFIERS)[algorithm.id] = algorithm


for _a in (HashAlgorithm("phash", "Perceptual hash", 8, hashing.perceptual_hash), HashAlgorithm("dhash", "Difference hash", 10, hashing.difference_hash), VerifyAlgorithm("ssim", "Structural similarity", 0.82, True, hashing.ssim, bounds.ssim_verifier), VerifyAlgorithm("nmse", "Normalised mean squared error", 0.05, False, hashing.nmse, bounds.nmse_verifier)):
    register(_a)

# The scan presets.
PRESETS = {
    "balanced": Preset(("phash", "dhash"), {"phash": 8, "dhash": 8}, "union", ("ssim",), {"ssim": 0.82}, {"time_window_hours": 1, "parallel_threads": 8}),
    "fast": Preset(("dhash",), {"dhash": 8}, "union", ("ssim",), {"ssim": 0.75}, {"time_window_hours": 0, "parallel_threads": 16}),
    "conservative": Preset(("phash",), {"phash": 6}, "union", ("ssim",), {"ssim": 0.85}, {"time_window_hours": 2, "parallel_threads": 4}),
    "precise": Preset(("phash", "dhash"), {"phash": 8, "dhash": 8}, "intersection", ("ssim", "nmse"), {"ssim": 0.82, "nmse": 0.05}, {"time_window_hours": 1, "parallel_threads": 8}),
}


def detect_preset(config: Preset) -> str:
    """The preset with these settings, else ``custom``."""
    return next((name for name, preset in PRESETS.items() if preset == config), "custom")


CONFIG = "hash_algorithms array<string>, hash_thresholds map<string,int>, merge_strategy string, verify_algorithms array<string>, verify_thresholds map<string,double>"


def config_presets(configs: Column) -> Column:
    """The preset of a stored JSON configuration, else ``custom``; orders of map entries do not matter."""
    given = F.from_json(configs, CONFIG)
    sorted_map = lambda m: F.array_sort(F.map_entries(m))
    out = F.lit("custom")
    for name, p in PRESETS.items():
        entries = lambda d, kind: sorted_map(F.from_json(F.lit(json.dumps(d)), f"map<string,{kind}>"))
        same = (
            (given["hash_algorithms"] == F.array(*map(F.lit, p.hash_algorithms)))
            & (sorted_map(given["hash_thresholds"]) == entries(p.hash_thresholds, "int"))
            & (given["merge_strategy"] == p.merge_strategy)
            & (given["verify_algorithms"] == F.array(*map(F.lit, p.verify_algorithms)))
            & (sorted_map(given["verify_thresholds"]) == entries(p.verify_thresholds, "double"))
        )
        out = F.when(F.coalesce(same, F.lit(False)), name).otherwise(out)
    return out


def resolve(ids: tuple[str, ...], known: dict) -> list:
    """Registered algorithms of these ids; unknown ones are left out."""
    return [known[i] for i in ids if i in known]


def verifier(algorithm: VerifyAlgorithm, threshold: float) -> clustering.Verifier:
    if algorithm.bounded:
        return algorithm.bounded(threshold)
    return clustering.Verifier(algorithm.score, (lambda s: s >= threshold) if algorithm.at_least else (lambda s: s <= threshold))


def skipped(files: DataFrame) -> DataFrame:
    """(path, reason) of the files a scan cannot use, each once: no raster, or an empty one.

    ``files`` has path, grey and error (what decoding said, or null).
    """
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("grey").isNull(), "unreadable").when(F.size("grey") == 0, "empty")
    return files.select("path", reason.alias("reason")).where(F.col("reason").isNotNull()).groupBy("path").agg(F.min("reason").alias("reason"))


def scan_result(members: DataFrame, photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, photos) that replace the stored ones after a scan.

    ``members`` is what ``scan`` returns, ``photos`` has seq, path and
    file_size; an unknown size is 0.
    """
    named = photos.select(F.col("seq").alias("member"), "path", F.coalesce("file_size", F.lit(0)).alias("file_size"))
    rows = members.join(named, "member").select(F.col("member").alias("id"), "group_id", "path", "file_size", "quality", "is_master")
    groups = rollup(rows).withColumn("review_status", F.lit("pending")).withColumn("decision", F.lit(None).cast("string"))
    return groups, rows


#: Which states of a scan may follow which.
FOLLOWS = {"running": ("paused",), "paused": ("running",), "completed": ("running",), "failed": ("running", "paused"), "cancelled": ("running", "paused")}


def set_status(scans: DataFrame, which: Column, status: str, now: Column, error: str | None = None) -> DataFrame:
    """Scan rows after those of ``which`` go into ``status``, where their state allows it.

    An end state also gets ``ended_at``, a failure its message.
    """
    hit = which & F.col("status").isin(*FOLLOWS[status])
    ends = status in ("completed", "failed", "cancelled")
    out = scans.withColumn("ended_at", F.when(hit & F.lit(ends), now)).withColumn("error_message", F.when(hit & F.lit(status == "failed"), F.lit(error)))
    return out.withColumn("status", F.when(hit, status).otherwise(F.col("status")))


def scan(rasters: DataFrame, preset: Preset, thresholds: dict[str, int] | None = None) -> DataFrame:
    """group_id, member, quality and is_master of every verified group.

    ``rasters`` has seq (the input order) and grey (64 grey values); rows
    whose grey is null are skipped.  ``thresholds`` override the preset's.
    """
    algorithms = resolve(preset.hash_algorithms, HASHES)
    if not algorithms:
        raise ValueError("no hash algorithm")
    usable = materialise(rasters.where(F.col("grey").isNotNull()).select("seq", "grey"), "rasters")
    hashed = materialise(usable.select(F.col("seq").alias("id"), *(a.expression(F.col("grey")).alias(a.id) for a in algorithms)), "hashes")
    limits = {**preset.hash_thresholds, **(thresholds or {})}
    distances = {a.id: int(limits.get(a.id, a.default_threshold)) for a in algorithms}
    if preset.merge_strategy == "union" and len(distances) > 1:
        merged = merge_edges([union_edges(hashed, "id", distances)])
    else:
        merged = merge_groups(hash_groups_of(hashed, "id", distances), preset.merge_strategy)
    members = materialise(merged.select(F.col("label").alias("group_id"), F.col("id").alias("seq")).join(usable, "seq"), "members")
    checks = [verifier(a, preset.verify_thresholds.get(a.id, a.default_threshold)) for a in resolve(preset.verify_algorithms, VERIFIERS)]
    verified = clustering.verify(members, checks)
    cells = [c for c in verified.columns if c not in ("seq", "grey")]
    rated = verified.select(*cells, "seq", hashing.quality(F.col("grey")).alias("quality"))
    best = Window.partitionBy(*cells).orderBy(F.desc("quality"), "seq")
    out = rated.withColumn("is_master", F.row_number().over(best) == 1).withColumn("group_id", F.min("seq").over(Window.partitionBy(*cells)))
    return out.select("group_id", F.col("seq").alias("member"), "quality", "is_master")


def document_groups(docs: DataFrame, labels: DataFrame, distance: int = 8) -> DataFrame:
    """Near-duplicate documents by word hash: the best member and sizes of each group.

    Quality is the label's, 0 where unknown; ties go to the smaller id.
    """
    hashed = materialise(hashing.text_hashes(docs, "doc_id", "text"), "hashes")
    grouped = at_least_two(hash_groups(hashed, "doc_id", "h0", distance))
    rated = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    rows = grouped.join(docs.select(F.col("doc_id").alias("id"), "n_chars"), "id").join(rated, "id", "left").withColumn("quality", F.coalesce("quality", F.lit(0)))
    best = F.max_by("id", F.struct("quality", -F.col("id")))
    return rows.groupBy(F.col("label").alias("group_id")).agg(F.count("*").alias("file_count"), F.sum("n_chars").alias("total_size"), best.alias("master_id"), F.max("quality").cast("int").alias("master_quality"))
