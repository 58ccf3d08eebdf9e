"""Normalisation counts, pair metrics, top-k details, snapshot tables and camera boxes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rings as R
from .service import PUBLIC

#: Square degrees below which a part or hole of a source counts as noise; square metres of gap or overlap that matter.
AREA_FLOOR = 1e-9
PAIR_FLOOR = 1e-6
NARROW_LIMIT, WARN_SHARE = 65_535, 0.8


def normalise(territories: DataFrame, floor: float = AREA_FLOOR) -> DataFrame:
    """territory, geometry -> geometry without parts and holes of no more than `floor`, and how many of each went."""
    g = F.col("geometry")
    ring_area = lambda r: F.abs(R.signed_area(r))
    gone_parts = F.filter(g, lambda p: ring_area(F.element_at(p, 1)) <= floor)
    kept = F.filter(g, lambda p: ring_area(F.element_at(p, 1)) > floor)
    gone_holes = F.filter(F.flatten(F.transform(kept, lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))))), lambda r: ring_area(r) <= floor)
    note = lambda x: F.format_string("%.2e", ring_area(x))
    return territories.select(
        "territory",
        R.drop_small(g, floor).alias("geometry"),
        F.size(gone_parts).alias("dropped_parts"),
        F.size(gone_holes).alias("dropped_holes"),
        F.array_sort(F.transform(gone_parts, lambda p: note(F.element_at(p, 1)))).alias("part_details"),
        F.array_sort(F.transform(gone_holes, note)).alias("hole_details"),
    )


def normalisation_totals(normalised: DataFrame) -> DataFrame:
    return normalised.agg(F.count(F.lit(1)).alias("features"), F.coalesce(F.sum("dropped_parts"), F.lit(0)).alias("dropped_parts"), F.coalesce(F.sum("dropped_holes"), F.lit(0)).alias("dropped_holes"))


def mixed_groups(features: DataFrame, group: str = "shape_group") -> DataFrame:
    """Datasets whose features name more than one group."""
    return features.groupBy("dataset").agg(F.array_sort(F.collect_set(group)).alias("groups")).where(F.size("groups") > 1)


def affected_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (label, gap, overlap) with a gap or an overlap worth naming."""
    return pairs.where((F.col("gap") > PAIR_FLOOR) | (F.col("overlap") > PAIR_FLOOR))


def pair_totals(pairs: DataFrame) -> DataFrame:
    bad = (F.col("gap") > PAIR_FLOOR) | (F.col("overlap") > PAIR_FLOOR)
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(bad).alias("affected"), F.sum("gap").alias("gap"), F.sum("overlap").alias("overlap"))


def worst_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k worst by gap plus overlap, then label; a top-k, no full sort."""
    return affected_pairs(pairs).withColumn("score", F.col("gap") + F.col("overlap")).orderBy(F.desc("score"), F.desc("label")).limit(k)


def mismatched_segments(source: Column, after: Column) -> Column:
    """Shared segments that a simplification no longer shares."""
    return F.greatest(source - after, F.lit(0))


def dropped_details(dropped: DataFrame, k: int = 5) -> DataFrame:
    """The k largest dropped parts (territory, area) of each level (lod), largest first, equal ones by territory."""
    n = F.row_number().over(Window.partitionBy("lod").orderBy(F.desc("area"), "territory"))
    return dropped.withColumn("rank", n).where(F.col("rank") <= k)


def busiest_regions(changes: DataFrame) -> DataFrame:
    """territory, total of merges, splits and creations, busiest first, then by id."""
    t = changes.groupBy("territory").agg(F.sum(F.col("merges") + F.col("splits") + F.col("created")).alias("total"))
    return t.orderBy(F.desc("total"), "territory")


def index_width_warnings(meshes: DataFrame) -> DataFrame:
    """Meshes (id, vertex_count) that are near the limit of 16-bit indices, with their share of it."""
    return meshes.withColumn("share", F.col("vertex_count") / NARROW_LIMIT).where((F.col("vertex_count") <= NARROW_LIMIT) & (F.col("share") >= WARN_SHARE))


def public_fields(entries: DataFrame) -> DataFrame:
    """What a listing shows of an entry; absent lists are empty, an absent flag is false."""
    put = {"neighbor_ids": F.coalesce("neighbor_ids", F.array().cast("array<string>")), "lossy": F.coalesce("lossy", F.lit(False))}
    return entries.withColumns(put).select(*PUBLIC)


def write_snapshot(meshes: DataFrame, path: str) -> None:
    """Meshes (dataset, revision_id, lod, id, min_x ...) as Parquet that prunes by directory and by row group.

    Files are ranged by id, so a keyset seek reads the files behind its key.
    """
    parts = ["dataset", "revision_id", "lod"]
    meshes.repartitionByRange(*parts, "id").sortWithinPartitions(*parts, "id").write.partitionBy(*parts).mode("append").parquet(path)


def ground_box(rays: DataFrame, *by: str) -> DataFrame:
    """The box on the plane z = 0 that rays (ox, oy, oz, dx, dy, dz) hit; misses are skipped, without hits there is no box."""
    t = -F.col("oz") / F.col("dz")
    hit = rays.where((F.col("dz") != 0) & (t >= 0) & (F.abs(t) < float("inf"))).select(*by, (F.col("ox") + t * F.col("dx")).alias("x"), (F.col("oy") + t * F.col("dy")).alias("y"))
    return hit.groupBy(*by).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def canonical_json(document: dict) -> str:
    """A report or manifest as it is stored: keys sorted, two spaces, UTF-8 as it is, a newline at the end."""
    return json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n"


def simplification_block(levels: DataFrame, *by: str) -> DataFrame:
    """`by`, block: JSON of a level's simplification (lod, tolerance, source_area, output_area, removed_area, added_area, dropped_part_area, source_parts, parts, source_holes, holes, topology_changes)."""
    ratio = F.when(F.col("source_area") > 0, F.col("output_area") / F.col("source_area")).otherwise(1.0)
    budget = F.struct(F.col("source_area").alias("source"), F.col("output_area").alias("output"), F.col("removed_area").alias("removed"), F.col("added_area").alias("added"), F.col("dropped_part_area").alias("droppedParts"))
    counts = F.struct(F.col("source_parts").alias("sourceParts"), F.col("parts").alias("parts"), F.col("source_holes").alias("sourceHoles"), F.col("holes").alias("holes"))
    block = F.struct(F.col("lod"), F.col("tolerance"), budget.alias("areaBudget"), ratio.alias("retainedAreaRatio"), counts.alias("counts"), F.col("topology_changes").alias("topologyChanges"))
    return levels.select(*by, F.to_json(block).alias("block"))
