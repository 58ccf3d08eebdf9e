"""Levels of detail: crossings repaired, invented holes removed, books that balance, nothing vanishes unseen."""

import pytest

from regionspark.operators import account, levels

RINGS = "territory string, part int, ring int, points array<struct<x:double,y:double>>"


def _rows(spark, shapes):
    return spark.createDataFrame([(t, p, r, [(float(x), float(y)) for x, y in points]) for t, rings in shapes.items() for p, r, points in rings], RINGS)


def _box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_holes_in_both_directions(spark):
    whole = _box(0, 0, 20, 20)
    source = {
        "invented": [(0, 0, whole)],
        "dropped": [(0, 0, whole), (0, 1, _box(2, 2, 4, 4)), (0, 2, _box(10, 10, 12, 12))],
        "merged": [(0, 0, whole), (0, 1, _box(2, 2, 4, 4)), (0, 2, _box(5, 2, 7, 4))],
        "split": [(0, 0, whole), (0, 1, _box(2, 2, 8, 4))],
    }
    output = {
        "invented": [(0, 0, whole), (0, 1, _box(6, 6, 7, 9))],
        "dropped": [(0, 0, whole), (0, 1, _box(10, 10, 12, 12))],
        "merged": [(0, 0, whole), (0, 1, _box(2, 2, 7, 4))],
        "split": [(0, 0, whole), (0, 1, _box(2, 2, 4, 4)), (0, 2, _box(5, 2, 8, 4))],
    }
    kept, events, dropped = levels.resolve_holes(_rows(spark, output), _rows(spark, source))
    assert {(r.territory, r.kind, r["count"], r.area) for r in events.collect()} == {("invented", "artifact_hole_removed", 1, 3.0), ("dropped", "dropped_hole", 1, 4.0), ("merged", "hole_merge", 1, 0.0), ("split", "hole_split", 1, 0.0)}
    assert {(r.territory, r.part, r.ring) for r in kept.collect()} == {(t, p, k) for t, rings in output.items() for p, k, _ in rings} - {("invented", 0, 1)}
    assert [(r.territory, r.area) for r in dropped.collect()] == [("dropped", 4.0)]


def test_crossings_of_thinned_rings_are_rebuilt(spark):
    # thinning takes the bump that a spike of the other side reaches into, so that the ring crosses itself
    shape = [(0, 0), (10, -1.5), (20, 0), (20, 10), (11, 10), (10, -1), (9, 10), (0, 10)]
    made = levels.simplify_levels(_rows(spark, {"t": [(0, 0, shape)]}), {"fine": 0.01, "coarse": 2.0})
    rings = {}
    for r in made.rings.collect():
        rings.setdefault(r.lod, []).append(([(p.x, p.y) for p in r.points], r.ring))
    assert [len(rings[k]) for k in ("fine", "coarse")] != [1, 1] and len(rings["fine"]) == 1
    accounts = made.accounts.withColumn("territory", account.F.col("lod"))
    assert account.budget_violations(accounts).count() == 0
    assert made.missing.count() == 0


def test_shared_borders_stay_shared_and_vanished_territories_are_errors(spark):
    left = [(0, 0), (5, 0), (5.25, 2), (5, 4), (5, 8), (0, 8)]
    right = [(5, 0), (10, 0), (10, 8), (5, 8), (5, 4), (5.25, 2)]
    rings = _rows(spark, {"l": [(0, 0, left)], "r": [(0, 0, right)], "tiny": [(0, 0, _box(30, 30, 30.5, 30.5))]})
    made = levels.simplify_levels(rings, {"high": 0.1, "low": 1.0})
    assert {(r.lod, r.territory) for r in made.missing.collect()} == {("low", "tiny")}
    with pytest.raises(levels.LevelError, match="tiny at low"):
        levels.require_all(made)
    at = {(r.lod, r.territory): {(p.x, p.y) for p in r.points} for r in made.rings.collect()}
    assert (5.25, 2) in at["high", "l"] and (5.25, 2) not in at["low", "l"] | at["low", "r"]
    events = {(r.lod, r.territory, r.kind): round(r.area, 9) for r in made.events.collect()}
    assert events == {("low", "l", "boundary_retreat"): 0.5, ("low", "r", "boundary_advance"): 0.5, ("low", "tiny", "dropped_part"): 0.25}
