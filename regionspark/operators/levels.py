"""Levels of detail in one plan: thinning with shared borders, repair, holes, accounts.

All levels share the one shuffle that finds fixed vertices. A small territory is then
one row, from which `wholes` tells all levels without a join; of large ones a row stands
for a ring at a level. Rings that thinning made cross are rebuilt by the overlay. Holes
that the source never had are taken out of the geometry. What became of parts and
holes is read off the areas that source and output share, by triangles, so the ledger
describes the geometry it comes with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._store import stored, tasks
from ..functions.rings import RING, polygon_area, signed_area
from . import account, mesh, overlay, wholes

#: Tolerances in degrees by level (fixed values).
TOLERANCES = {"high": 5e-5, "medium": 5e-4, "low": 2.5e-3}


class LevelError(ValueError):
    """A level that may not be published."""


@dataclass(frozen=True)
class Levels:
    """What simplify_levels made: rings (lod, territory, part, ring, points), events and accounts (lod, territory, ...)."""

    rings: DataFrame
    events: DataFrame
    accounts: DataFrame
    missing: DataFrame


def _key() -> Column:
    return F.struct("lod", "territory")


def thinned(rings: DataFrame, tolerances: dict[str, float]) -> DataFrame:
    """lod, territory, part, ring, points of rings (territory, part, ring, points: open) at every level; rings without area, and holes of exteriors without area, are gone."""
    return _alive(mesh.thin_levels(rings, tolerances))


def _alive(thin: DataFrame) -> DataFrame:
    alive = thin.where((F.size("points") >= 3) & (signed_area(F.col("points")) != 0))
    shells = alive.where("ring = 0").select("lod", "territory", "part")
    return alive.join(shells, ["lod", "territory", "part"], "left_semi")


def repaired(rings: DataFrame, quantum: float = overlay.QUANTUM) -> DataFrame:
    """rings (lod, territory, part, ring, points) with those of territories whose rings cross replaced by their even-odd surface, parts by decreasing area."""
    keyed = rings.select(_key().alias("territory"), "part", "ring", "points")
    bad = stored(overlay.ring_faults(keyed, quantum).select(F.col("territory").alias("grp")).distinct(), "crossing-levels")
    if bad.isEmpty():
        return rings
    crossing = keyed.withColumnRenamed("territory", "grp").join(bad, "grp", "left_semi")
    made = overlay.surfaces(crossing.select("grp", "points"), quantum)
    parts = made.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("a"), "rings"))).alias("p"))
    parts = parts.select("grp", F.posexplode("p.rings").alias("part", "r")).select("grp", "part", F.posexplode("r").alias("ring", "points"))
    sound = keyed.withColumnRenamed("territory", "grp").join(bad, "grp", "left_anti")
    return sound.unionByName(parts.select("grp", F.col("part").cast("int"), F.col("ring").cast("int"), "points")).select("grp.lod", "grp.territory", "part", "ring", "points")


def surface_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """territory, i, j, area > 0: what surfaces of the same territory (text) share; both have territory, part, rings (the exterior first)."""
    tri = lambda df, label: stored(mesh.triangulate(df), label)
    shared = mesh.territory_overlaps(tri(left, "left-triangles"), tri(right, "right-triangles"))
    return shared.select("territory", F.col("l_part").alias("i"), F.col("r_part").alias("j"), "area")


def _holes(rings: DataFrame) -> DataFrame:
    """territory, hole (numbered within the territory), part, ring, points, area of all inner rings."""
    per = rings.where("ring > 0").groupBy("territory").agg(F.array_sort(F.collect_list(F.struct("part", "ring", "points"))).alias("h"))
    return per.select("territory", F.posexplode("h").alias("hole", "r")).select("territory", "hole", "r.part", "r.ring", "r.points", F.abs(signed_area(F.col("r.points"))).alias("area"))


def resolve_holes(output: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(output without invented holes, hole events, dropped source holes) of rings (territory: text, part, ring, points).

    An output hole that corresponds to no source hole was made by
    simplification and goes; a source hole without a partner is dropped:
    the territory now covers its ground.
    """
    s, o = stored(_holes(source), "source-holes"), stored(_holes(output), "output-holes")
    as_part = lambda h: h.select("territory", F.col("hole").alias("part"), F.array("points").alias("rings"))
    shared = stored(surface_overlaps(as_part(s), as_part(o)), "hole-overlaps")
    sized = shared.join(s.select("territory", F.col("hole").alias("i"), F.col("area").alias("sa")), ["territory", "i"]).join(o.select("territory", F.col("hole").alias("j"), F.col("area").alias("oa")), ["territory", "j"])
    partners = sized.where(F.col("area") >= account.CORRESPONDENCE * F.least("sa", "oa"))
    invented = o.join(partners.select("territory", F.col("j").alias("hole")), ["territory", "hole"], "left_anti").select("territory", "part", "ring")
    kept = output.join(invented, ["territory", "part", "ring"], "left_anti")
    dropped = s.join(partners.select("territory", F.col("i").alias("hole")), ["territory", "hole"], "left_anti")
    events = account.hole_events(s.select("territory", "hole", "area"), o.select("territory", "hole", "area"), shared)
    return kept, events, dropped


def _parts(rings: DataFrame) -> DataFrame:
    """territory, part, rings, area."""
    p = rings.groupBy("territory", "part").agg(F.array_sort(F.collect_list(F.struct("ring", "points"))).alias("r")).select("territory", "part", F.col("r.points").alias("rings"))
    return p.withColumn("area", polygon_area(F.col("rings")))


def simplify_levels(rings: DataFrame, tolerances: dict[str, float] = TOLERANCES, quantum: float = overlay.QUANTUM) -> Levels:
    """Every level of rings (territory: text, part, ring, points: open) with its events and accounts; areas in squares of the coordinates' unit.

    events: lod, territory, kind, count, area, as account.account_events and
    hole_events have them, a dropped hole's ground counted once. accounts: the
    columns of account.budget_violations. missing: lod, territory of territories
    without a part; `require_all` makes these an error.

    Small territories are one row each and need no join. Large ones, and levels of
    others whose thinned rings are not clearly sound, go by joins.
    """
    source = stored(rings.select("territory", "part", "ring", "points"), "level-source")
    fixed = mesh.fixed_vertices(source)
    large = stored(source.groupBy("territory").agg(F.sum(F.size("points")).alias("n")).where(F.col("n") > wholes.SMALL).select("territory"), "large-territories")
    some = not large.isEmpty()
    few = source.join(large, "territory", "left_anti") if some else source
    whole = stored(_whole(few, fixed, tolerances, quantum), "whole-levels")
    left = whole.where(~F.col("sound"))
    done = whole.where("sound")
    of_whole = lambda column: done.select("lod", "territory", F.inline(column))
    gone = lambda made: F.size(made) == 0
    made = Levels(of_whole("rings"), of_whole("events"), done.select("lod", "territory", "account.*"), done.where(gone("rings")).select("lod", "territory"))
    keys, thin = left.select("lod", "territory"), left.select("lod", "territory", F.inline("rings"))
    if some:
        keys = keys.unionByName(large.select(F.explode(F.array(*[F.lit(x) for x in tolerances])).alias("lod"), "territory"))
        big = lambda df: df.join(large, "territory", "left_semi")
        thin = thin.unionByName(_alive(mesh.thin_levels(big(source), tolerances, big(fixed))))
    elif left.isEmpty():
        return made
    rest = _by_joins(source.join(keys.hint("merge"), "territory").select("lod", *source.columns), thin, quantum)
    both = [a.unionByName(b) for a, b in zip((made.rings, made.events, made.accounts, made.missing), (rest.rings, rest.events, rest.accounts, rest.missing))]
    return Levels(*both)


def _whole(rings: DataFrame, fixed: DataFrame, tolerances: dict[str, float], quantum: float) -> DataFrame:
    """Rows of wholes.SCHEMA of rings (territory, part, ring, points) of small territories; fixed: mesh.fixed_vertices of all rings."""
    n = tasks(rings.sparkSession)
    of = lambda df, column, *names: df.repartition(n, "territory").groupBy("territory").agg(F.array_sort(F.collect_list(F.struct(*names))).alias(column))
    rows = of(rings, "r", F.col("part").cast("int").alias("part"), F.col("ring").cast("int").alias("ring"), F.coalesce("points", F.array().cast(RING)).alias("points"))
    marks = of(fixed, "f", F.col("part").cast("int").alias("part"), F.col("ring").cast("int").alias("ring"), "seq")
    rows = rows.join(marks.hint("merge"), "territory", "left").select("territory", "r", "f")
    return rows.mapInArrow(lambda batches: wholes.whole_levels(batches, tolerances, quantum), wholes.WHOLE)


def _by_joins(rings: DataFrame, thin: DataFrame, quantum: float) -> Levels:
    """Levels of rings (lod, territory, part, ring, points) and what thinning left of them, for rings and parts of any number."""
    whole = F.to_json(_key()).alias("territory")  # one text a level and territory
    source = stored(rings.select(whole, "part", "ring", "points"), "level-source")
    made = repaired(stored(thin, "level-thin"), quantum)
    output, holes, dropped = resolve_holes(stored(made.select(whole, "part", "ring", "points"), "level-output"), source)
    output = stored(output, "level-rings")
    src, out = stored(_parts(source), "source-parts"), stored(_parts(output), "output-parts")
    shared = surface_overlaps(src.drop("area"), out.drop("area"))
    shared = stored(shared, "part-overlaps")
    dropped = stored(dropped, "dropped-holes")
    fill = stored(surface_overlaps(dropped.select("territory", F.col("hole").alias("part"), F.array("points").alias("rings")), out.drop("area")), "hole-fill")
    moved = account.account_events(src.select("territory", "part", "area"), out.select("territory", "part", "area"), shared, fill.groupBy("territory", "j").agg(F.sum("area").alias("filled")))
    # what the sums of triangles leave of nothing is no movement
    noise = src.groupBy("territory").agg((F.sum("area") * account.RELATIVE_SLACK).alias("noise"))
    moved = moved.join(noise, "territory", "left").where(~F.col("kind").startswith("boundary_") | (F.col("area") > F.coalesce("noise", F.lit(0.0)))).drop("noise")
    ground = fill.groupBy("territory").agg(F.sum("area").alias("ground"))
    # a dropped hole's area is what of it the territory covers now
    holes = holes.join(ground, "territory", "left").withColumn("area", F.when(F.col("kind") == "dropped_hole", F.coalesce("ground", F.lit(0.0))).otherwise(F.col("area"))).drop("ground")
    events = stored(moved.unionByName(holes), "level-events")
    count = lambda df, n: df.groupBy("territory").agg(F.count_if(F.col("ring") == 0).alias(f"{n}parts"), F.count_if(F.col("ring") > 0).alias(f"{n}holes"))
    total = lambda df, n: df.groupBy("territory").agg(F.sum("area").alias(n))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("count"))), F.lit(0))
    removed = F.col("kind").isin("dropped_part", "boundary_retreat", "part_split")
    added = F.col("kind").isin("dropped_hole", "boundary_advance", "part_merge", "part_created")
    said = events.groupBy("territory").agg(
        F.sum(F.when(removed, F.col("area")).otherwise(0.0)).alias("removed_area"), F.sum(F.when(added, F.col("area")).otherwise(0.0)).alias("added_area"),
        *[of(k).alias(n) for k, n in (("dropped_part", "dropped"), ("part_merge", "merges"), ("part_split", "splits"), ("part_created", "created"), ("dropped_hole", "dropped_holes"), ("hole_merge", "hole_merges"), ("hole_split", "hole_splits"))],
    )
    a = count(source, "source_").join(total(src, "source_area"), "territory").join(count(output, ""), "territory", "left").join(total(out, "output_area"), "territory", "left")
    a = a.join(total(shared, "shared"), "territory", "left").join(said, "territory", "left").na.fill(0)
    a = a.withColumns({"measured_removed": F.greatest(F.col("source_area") - F.col("shared"), F.lit(0.0)), "measured_added": F.greatest(F.col("output_area") - F.col("shared"), F.lit(0.0))}).drop("shared")
    key = F.from_json("territory", "lod string, territory string")
    back = lambda df: df.withColumn("__k", key).select("__k.lod", "__k.territory", *[c for c in df.columns if c != "territory"])
    missing = source.select("territory").distinct().join(output.select("territory").distinct(), "territory", "left_anti")
    return Levels(back(output), back(events), back(a), back(missing))


def require_all(levels: Levels) -> Levels:
    """The levels, or an error that names territories which simplification has made vanish."""
    gone = [f"{r.territory} at {r.lod}" for r in levels.missing.orderBy("territory", "lod").limit(10).collect()]
    if gone:
        raise LevelError("simplified away entirely: " + ", ".join(gone))
    return levels
