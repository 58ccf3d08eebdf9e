"""Accounting for a simplification: which parts were lost, merged, split, made, and where area went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._store import stored
from .grid import level_join

#: A part corresponds if an overlap has this share of the smaller of both; less cover than this share means it is gone.
CORRESPONDENCE = 0.1
SEVERE = 0.5
ABSOLUTE_SLACK, RELATIVE_SLACK = 1.0, 1e-9
MAX_PART_AREA, MAX_TOTAL_AREA = 10_000.0, 50_000.0


def box_overlaps(source: DataFrame, output: DataFrame) -> DataFrame:
    """territory, i, j, area > 0 of rectangular parts (territory, part, x0, y0, x1, y1) that overlap.

    Parts meet by territory, in large ones by grid, so a territory of many parts does not
    compare all with all; general polygons get their overlaps from triangles
    instead.
    """
    box = lambda df: df.select("territory", "part", F.col("x0").alias("min_x"), F.col("y0").alias("min_y"), F.col("x1").alias("max_x"), F.col("y1").alias("max_y"))
    near = level_join(box(source), box(output), ("territory",))
    w = F.least("l_max_x", "r_max_x") - F.greatest("l_min_x", "r_min_x")
    h = F.least("l_max_y", "r_max_y") - F.greatest("l_min_y", "r_min_y")
    return near.where((w > 0) & (h > 0)).select("territory", F.col("l_part").alias("i"), F.col("r_part").alias("j"), (w * h).alias("area"))


def part_accounts(source: DataFrame, output: DataFrame, overlaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(territory, i, area, covered, gone, degree), (territory, j, area, covered, degree) of source and output parts.

    source, output: territory, part, area. Edges of gone parts are cut before
    degrees are counted.
    """
    # three aggregations and a join read them
    overlaps = stored(overlaps, "overlaps")
    src = source.select("territory", F.col("part").alias("i"), F.col("area").alias("sa"))
    out = output.select("territory", F.col("part").alias("j"), F.col("area").alias("oa"))
    by_i = overlaps.groupBy("territory", "i").agg(F.sum("area").alias("covered"))
    s = src.join(by_i, ["territory", "i"], "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    s = s.withColumn("gone", (F.col("sa") > 0) & (F.col("covered") < CORRESPONDENCE * F.col("sa")))
    edges = overlaps.join(s.where(~F.col("gone")).select("territory", "i", "sa"), ["territory", "i"]).join(out, ["territory", "j"])
    smaller = F.least("sa", "oa")
    edges = edges.where((smaller > 0) & (F.col("area") >= CORRESPONDENCE * smaller))
    deg_i = edges.groupBy("territory", "i").agg(F.count(F.lit(1)).alias("degree"))
    deg_j = edges.groupBy("territory", "j").agg(F.count(F.lit(1)).alias("degree"))
    by_j = overlaps.groupBy("territory", "j").agg(F.sum("area").alias("covered"))
    s = s.join(deg_i, ["territory", "i"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    o = out.join(by_j, ["territory", "j"], "left").join(deg_j, ["territory", "j"], "left")
    o = o.withColumn("covered", F.coalesce("covered", F.lit(0.0))).withColumn("degree", F.coalesce("degree", F.lit(0)))
    return stored(s, "source-accounts"), stored(o, "output-accounts")


def account_events(source: DataFrame, output: DataFrame, overlaps: DataFrame, filled: DataFrame | None = None, accounts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """territory, kind, count, area: every difference between source and output parts.

    filled (territory, j, filled): ground of dropped holes that output parts
    cover now; it is accounted for with the holes, not as movement. accounts:
    part_accounts of the same, if they are there already.
    """
    s, o = accounts or part_accounts(source, output, overlaps)
    left = F.greatest(F.col("sa") - F.col("covered"), F.lit(0.0))
    lost = F.col("gone") | (F.col("degree") == 0)
    s = s.withColumn("res", left).withColumn("lost", lost)
    kind = F.when(F.col("lost"), "dropped_part").when(F.col("degree") > 1, "part_split").otherwise("boundary_retreat")
    times = F.when(F.col("degree") > 1, F.col("degree") - 1).otherwise(1)
    a = s.groupBy("territory", kind.alias("kind")).agg(F.sum(F.when(F.col("lost"), 1).otherwise(times)).alias("n"), F.sum("res").alias("area"))
    shrunk = s.where(~F.col("lost") & (F.col("sa") > 0) & (F.col("covered") < SEVERE * F.col("sa"))).groupBy("territory").agg(F.count(F.lit(1)).alias("n"))
    if filled is not None:
        o = o.join(filled, ["territory", "j"], "left").withColumn("covered", F.col("covered") + F.coalesce("filled", F.lit(0.0))).drop("filled")
    o = o.withColumn("res", F.greatest(F.col("oa") - F.col("covered"), F.lit(0.0)))
    kind = F.when(F.col("degree") == 0, "part_created").when(F.col("degree") > 1, "part_merge").otherwise("boundary_advance")
    b = o.groupBy("territory", kind.alias("kind")).agg(F.sum(times).alias("n"), F.sum("res").alias("area"))
    moved = F.col("kind").isin("boundary_retreat", "boundary_advance")
    both = a.unionByName(b).withColumn("n", F.when(moved, F.lit(1)).otherwise(F.col("n"))).where(~moved | (F.col("area") > 0))
    both = both.unionByName(shrunk.select("territory", F.lit("severe_shrink").alias("kind"), "n", F.lit(0.0).alias("area")))
    return both.select("territory", "kind", F.col("n").cast("long").alias("count"), "area")


def budget_violations(accounts: DataFrame) -> DataFrame:
    """territory, rule of every identity that an account breaks.

    accounts: territory, source_area, output_area, removed_area, added_area,
    measured_removed, measured_added, source_parts, parts, dropped, merges,
    splits, created, source_holes, holes, dropped_holes, hole_merges, hole_splits.
    """
    slack = F.greatest(F.lit(ABSOLUTE_SLACK), RELATIVE_SLACK * F.col("source_area"))
    off = lambda x: F.abs(x) > slack
    rules = F.array_compact(
        F.array(
            F.when(off(F.col("source_area") + F.col("added_area") - F.col("removed_area") - F.col("output_area")), "area_balance"),
            F.when(off(F.col("removed_area") - F.col("measured_removed")), "removed_measure"),
            F.when(off(F.col("added_area") - F.col("measured_added")), "added_measure"),
            F.when(F.col("source_parts") - F.col("parts") != F.col("dropped") + F.col("merges") - F.col("splits") - F.col("created"), "part_count"),
            F.when(F.col("source_holes") - F.col("holes") != F.col("dropped_holes") + F.col("hole_merges") - F.col("hole_splits"), "hole_count"),
        )
    )
    return accounts.select("territory", F.explode(rules).alias("rule"))


def gate_violations(dropped: DataFrame, max_part: float = MAX_PART_AREA, max_total: float = MAX_TOTAL_AREA) -> DataFrame:
    """territory, rule of dropped parts (territory, area) that are too large, alone or together over all territories."""
    single = dropped.where(F.col("area") > max_part).select("territory", F.lit("dropped_part_area").alias("rule"))
    total = dropped.agg(F.sum("area").alias("area")).where(F.col("area") > max_total)
    return single.unionByName(total.select(F.lit(None).cast("string").alias("territory"), F.lit("total_dropped_area").alias("rule")))


def hole_events(source: DataFrame, output: DataFrame, overlaps: DataFrame) -> DataFrame:
    """territory, kind, count, area of holes (territory, hole, area) lost, invented, merged or split.

    overlaps: territory, i, j, area > 0 between source and output holes. Holes
    correspond as parts do. A source hole without a partner is a dropped_hole:
    its area is ground that was added. An output hole without one is an
    artifact, to be removed from the geometry.
    """
    s = source.select("territory", F.col("hole").alias("i"), F.col("area").alias("sa"))
    o = output.select("territory", F.col("hole").alias("j"), F.col("area").alias("oa"))
    smaller = F.least("sa", "oa")
    e = overlaps.join(s, ["territory", "i"]).join(o, ["territory", "j"]).where((smaller > 0) & (F.col("area") >= CORRESPONDENCE * smaller))
    by_i = e.groupBy("territory", "i").agg(F.count(F.lit(1)).alias("d"))
    by_j = e.groupBy("territory", "j").agg(F.count(F.lit(1)).alias("d"))
    lost = s.join(by_i, ["territory", "i"], "left_anti").groupBy("territory").agg(F.count(F.lit(1)).alias("count"), F.sum("sa").alias("area"))
    new = o.join(by_j, ["territory", "j"], "left_anti").groupBy("territory").agg(F.count(F.lit(1)).alias("count"), F.sum("oa").alias("area"))
    more = lambda d: d.where("d > 1").groupBy("territory").agg(F.sum(F.col("d") - 1).alias("count"), F.lit(0.0).alias("area"))
    named = [(lost, "dropped_hole"), (new, "artifact_hole_removed"), (more(by_j), "hole_merge"), (more(by_i), "hole_split")]
    parts = [df.select("territory", F.lit(kind).alias("kind"), "count", "area") for df, kind in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
