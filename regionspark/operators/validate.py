"""Rules over level reports and manifests: each returns its violations, so an empty table is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import SCHEMA_VERSION, STAGES

LODS = ("high", "medium", "low")
LOW_VERTEX_BUDGET = 0.25
MAX_DROPPED_PART_AREA, MAX_TOTAL_DROPPED_AREA = 10_000.0, 50_000.0
MAX_NORMALIZATION_DROPS = 20
RETAINED_TOLERANCE = 1e-9
#: Fields that a report and the build's manifest both state (fixed values).
COMPARED = ("territoryCount", "vertices", "triangles", "bytes", "partCount", "holeCount", "lossy", "topologyChanged", "pickingUnsafe")


class ValidationError(ValueError):
    """A strict check found violations."""


def lod_rank(lod: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LODS]), lod)


def _rule(df: DataFrame, by: list[str], name: str, broken: Column, lod: Column | None = None) -> DataFrame:
    return df.where(F.coalesce(broken, F.lit(True))).select(*by, (lod if lod is not None else F.lit(None).cast("string")).alias("lod"), F.lit(name).alias("rule"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ladder(levels: DataFrame, *by: str) -> DataFrame:
    """by, lod, rule: what a report's levels break.

    levels: by, lod, territory_count, vertices, triangles, source_parts, parts,
    source_holes, holes, largest_dropped, dropped_area - at most one row a level.
    A missing level hides the other rules of its report, for they compare levels.
    """
    keys = list(by)
    at = lambda name, lod: F.max(F.when(F.col("lod") == lod, F.col(name)))
    wide = levels.groupBy(*keys).agg(
        F.array_sort(F.collect_set("lod")).alias("have"),
        F.count_distinct("territory_count").alias("counts"),
        *[at("vertices", x).alias(f"v_{x}") for x in LODS],
        *[at(c, "high").alias(f"high_{c}") for c in ("parts", "source_parts", "holes", "source_holes")],
    )
    missing = F.size(F.array_except(F.array(*[F.lit(x) for x in LODS]), "have")) > 0
    whole = wide.where(~missing)
    each = levels.join(whole.select(*keys), keys, "left_semi")
    ratio = F.when(F.col("v_high") != 0, F.col("v_low") / F.col("v_high")).otherwise(1.0)
    lod = F.col("lod")
    return _all(
        [
            _rule(wide, keys, "missing_level", missing),
            _rule(whole, keys, "territory_count", F.col("counts") != 1),
            _rule(whole, keys, "not_coarsening", ~((F.col("v_high") > F.col("v_medium")) & (F.col("v_medium") > F.col("v_low")))),
            _rule(whole, keys, "low_vertex_budget", ratio > LOW_VERTEX_BUDGET),
            _rule(whole, keys, "high_parts", F.col("high_parts") != F.col("high_source_parts")),
            _rule(whole, keys, "high_holes", F.col("high_holes") != F.col("high_source_holes")),
            _rule(each, keys, "invented_holes", F.col("holes") > F.col("source_holes"), lod),
            _rule(each, keys, "no_triangles", F.col("triangles") <= 0, lod),
            _rule(each, keys, "dropped_part_area", F.coalesce("largest_dropped", F.lit(0.0)) > MAX_DROPPED_PART_AREA, lod),
            _rule(each, keys, "total_dropped_area", F.coalesce("dropped_area", F.lit(0.0)) > MAX_TOTAL_DROPPED_AREA, lod),
        ]
    )


def coarsening_steps(levels: DataFrame, *by: str) -> DataFrame:
    """Each level's vertices as a share of the level above it and of the finest."""
    w = Window.partitionBy(*by).orderBy(lod_rank(F.col("lod")))
    share = lambda whole: F.when(whole != 0, F.col("vertices") / whole)
    return levels.select(*by, "lod", "vertices", share(F.lag("vertices").over(w)).alias("of_finer"), share(F.first("vertices").over(w)).alias("of_high"))


def stages(blocks: DataFrame, *by: str) -> DataFrame:
    """blocks (by, lod, schema_version, recorded array, event_stages array): unknown versions, missing and unlisted stages."""
    keys = list(by)
    known = F.array(*[F.lit(s) for s in STAGES])
    return _all(
        [
            _rule(blocks, keys, "schema_version", F.col("schema_version") != SCHEMA_VERSION, F.col("lod")),
            _rule(blocks, keys, "missing_stage", F.size(F.array_except(known, "recorded")) > 0, F.col("lod")),
            _rule(blocks, keys, "unlisted_stage", F.size(F.array_except("event_stages", "recorded")) > 0, F.col("lod")),
        ]
    )


def area_budget(levels: DataFrame, *by: str) -> DataFrame:
    """levels (by, lod, source_area, output_area, removed_area, added_area, stated_removed, stated_added, retained): V6."""
    keys = list(by)
    slack = F.greatest(F.lit(1.0), 1e-9 * F.col("source_area"))
    retained = F.when(F.col("source_area") > 0, F.col("output_area") / F.col("source_area")).otherwise(1.0)
    lod = F.col("lod")
    return _all(
        [
            _rule(levels, keys, "area_balance", F.abs(F.col("source_area") + F.col("added_area") - F.col("removed_area") - F.col("output_area")) > slack, lod),
            _rule(levels, keys, "stated_removed", F.abs(F.col("stated_removed") - F.col("removed_area")) > slack, lod),
            _rule(levels, keys, "stated_added", F.abs(F.col("stated_added") - F.col("added_area")) > slack, lod),
            _rule(levels, keys, "retained_ratio", F.abs(F.col("retained") - retained) > RETAINED_TOLERANCE, lod),
        ]
    )


def counting(levels: DataFrame, counts: DataFrame, *by: str) -> DataFrame:
    """Part and hole identities of levels (by, lod, parts, source_parts, holes, source_holes) against event counts (by, lod, kind, count)."""
    keys = list(by)
    n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("count"))), F.lit(0)).alias(k)
    wide = counts.groupBy(*keys, "lod").agg(*[n(k) for k in ("dropped_part", "part_merge", "part_split", "part_created", "dropped_hole", "hole_merge", "hole_split")])
    both = levels.join(wide, [*keys, "lod"], "left").fillna(0)
    parts = F.col("dropped_part") + F.col("part_merge") - F.col("part_split") - F.col("part_created")
    holes = F.col("dropped_hole") + F.col("hole_merge") - F.col("hole_split")
    return _all(
        [
            _rule(both, keys, "part_identity", F.col("source_parts") - F.col("parts") != parts, F.col("lod")),
            _rule(both, keys, "hole_identity", F.col("source_holes") - F.col("holes") != holes, F.col("lod")),
        ]
    )


def declared_flags(levels: DataFrame, *by: str, allow_lossy_high: bool = False) -> DataFrame:
    """levels (by, lod, declared_lossy, lossy, picking_unsafe): a stated flag differs from the derived one, a lossy level calls itself safe, or the high level is lossy without leave."""
    keys = list(by)
    return _all(
        [
            _rule(levels, keys, "declared_lossy", F.col("declared_lossy").isNotNull() & (F.col("declared_lossy") != F.col("lossy")), F.col("lod")),
            _rule(levels, keys, "lossy_but_safe", F.col("lossy") & ~F.col("picking_unsafe"), F.col("lod")),
            _rule(levels, keys, "lossy_high", (F.col("lod") == "high") & F.col("lossy") & F.lit(not allow_lossy_high), F.col("lod")),
        ]
    )


def normalization(drops: DataFrame, upstream: DataFrame, *by: str) -> DataFrame:
    """The drops of a normalisation (by, kind, count, details) against each level's upstream events (by, lod, kind, count, details): too many, or not the same set."""
    keys = list(by)
    many = drops.groupBy(*keys).agg(F.sum("count").alias("n")).where(F.col("n") > MAX_NORMALIZATION_DROPS).select(*keys, F.lit(None).cast("string").alias("lod"), F.lit("too_many_drops").alias("rule"))
    every = drops.crossJoin(drops.sparkSession.createDataFrame([(x,) for x in LODS], "lod string")).select(*keys, "lod", "kind", "count", "details")
    seen = upstream.select(*every.columns)
    odd = every.exceptAll(seen).unionByName(seen.exceptAll(every)).select(*keys, "lod").distinct().withColumn("rule", F.lit("upstream_events"))
    return many.unionByName(odd)


def report_matches(report: DataFrame, manifest: DataFrame, fields=COMPARED, *by: str) -> DataFrame:
    """by, lod, field where two tables of levels differ, null-safe; levels of one side alone differ in every field."""
    keys = [*by, "lod"]
    tall = lambda df, name: df.select(*keys, F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields]))).alias("field", name))
    a, b = tall(report, "stated").withColumn("here", F.lit(True)), tall(manifest, "built").withColumn("there", F.lit(True))
    both = a.join(b, [*keys, "field"], "full_outer")
    return both.where(F.col("here").isNull() | F.col("there").isNull() | ~F.col("stated").eqNullSafe(F.col("built"))).select(*keys, "field", "stated", "built")


def pinned(totals: DataFrame, expected: DataFrame) -> DataFrame:
    """Exact sentinels: lod, field, expected, found where they differ."""
    return expected.join(totals, ["lod", "field"], "left").where(~F.col("expected").eqNullSafe(F.col("found"))).select("lod", "field", "expected", "found")


def require_empty(violations: DataFrame, what: str, show: int = 20) -> None:
    """Raise with the first violations, if there are any."""
    found = violations.limit(show).collect()
    if found:
        raise ValidationError(f"{what}: {'; '.join(str(r.asDict()) for r in found)}")
