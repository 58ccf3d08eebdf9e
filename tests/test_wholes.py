"""Levels of small territories in one piece: the same as by joins, and no joins where nothing crosses."""

import math
import random

import numpy as np
import pytest
from conftest import DATA

from regionspark.operators import levels, mesh, overlay, wholes
from regionspark.plans import geometry

RINGS = "territory string, part int, ring int, points array<struct<x:double,y:double>>"
TOLERANCES = {"fine": 0.02, "middle": 0.4, "coarse": 1.5}


def _box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def _star(rnd, x, y, r, n, exact):
    at = [(x + r * rnd.uniform(0.6, 1) * math.cos(2 * math.pi * k / n), y + r * rnd.uniform(0.6, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [(round(px * 8) / 8, round(py * 8) / 8) if exact else (px, py) for px, py in at]


def _territories(rnd, count):
    """Stars with holes and islands, on whole eighths or not, some alike, and a coverage with shared, crooked borders."""
    rows = []
    for k in range(count):
        x, y, exact = 40.0 * k, 1000.0, k % 3 > 0
        shape = random.Random(k % 7) if k % 2 else rnd
        add = lambda part, ring, points, t=f"s{k}": rows.append((t, part, ring, points))
        add(0, 0, _star(shape, x, y, 10, shape.choice([5, 9, 24]), exact))
        for h in range(shape.choice([0, 1, 2])):
            add(0, 1 + h, _star(shape, x - 2.5 + 5 * h, y, shape.choice([0.5, 2.0]), shape.choice([4, 8]), exact)[::-1])
        if shape.random() < 0.6:
            add(1, 0, _star(shape, x + shape.choice([0, 14]), y, shape.choice([0.4, 1.5, 3]), 6, exact))
    side = lambda a, b: [a, (a[0] + (b[0] - a[0]) / 3 + 0.3 * math.sin(a[0] + b[1]), a[1] + (b[1] - a[1]) / 3 + 0.3 * math.cos(a[1] + b[0]))]
    for i in range(3):
        for j in range(3):
            c = [(5.0 * (i + u), 5.0 * (j + v)) for u, v in ((0, 0), (1, 0), (1, 1), (0, 1))]
            forward = [p for a, b in zip(c, c[1:] + c[:1]) for p in (side(a, b) if a < b else [a, side(b, a)[1]])]
            rows.append((f"c{i}{j}", 0, 0, forward))
    return rows


def _told(made):
    """Rings from their least vertex on, vanished territories, and numbers of events and accounts by name."""

    def ring(points):
        p = [(v.x, v.y) for v in points]
        return tuple(p[p.index(min(p)) :] + p[: p.index(min(p))])

    numbers = {(r.lod, r.territory, r.kind, c): r[c] for r in made.events.collect() for c in ("count", "area")}
    for r in made.accounts.collect():
        numbers |= {(r.lod, r.territory, c): v for c, v in r.asDict().items() if c not in ("lod", "territory")}
    rings = sorted((r.lod, r.territory, r.part, r.ring, ring(r.points)) for r in made.rings.collect())
    return rings, sorted((r.lod, r.territory) for r in made.missing.collect()), numbers


def test_whole_territories_and_joins_give_the_same(spark, monkeypatch):
    """F1, F2."""
    rows = _territories(random.Random(11), 24)
    rings = spark.createDataFrame(rows, RINGS)
    left = []
    by_joins = levels._by_joins
    monkeypatch.setattr(levels, "_by_joins", lambda rings, *a: left.append(rings.select("lod", "territory").distinct().count()) or by_joins(rings, *a))
    whole = _told(levels.simplify_levels(rings, TOLERANCES))
    monkeypatch.setattr(wholes, "SMALL", 0)
    joined = _told(levels.simplify_levels(rings, TOLERANCES))
    assert left[-1] == 3 * 33 and 0 < left[0] < 33
    assert whole[:2] == joined[:2]
    assert whole[2] == pytest.approx(joined[2], rel=1e-9, abs=1e-9)  # sums of triangles come in any order
    assert {k[2] for k in whole[2] if len(k) == 4} >= {"boundary_retreat", "boundary_advance", "dropped_part", "dropped_hole", "part_merge"}


def test_sound_small_territories_need_no_overlay(spark, monkeypatch):
    """some hundred jobs of joins ran for every level, however small and sound the territories."""

    def fails(*_):
        raise AssertionError("an overlay of sound territories")

    for name in ("ring_faults", "surfaces"):
        monkeypatch.setattr(overlay, name, fails)
    events = {(r.lod, r.kind): r["count"] for r in geometry.level_events(spark, f"{DATA}/sf0.001").collect()}
    assert events["low", "boundary_retreat"] == events["medium", "boundary_retreat"] == 150
    assert [r.broken for r in geometry.level_accounts(spark, f"{DATA}/sf0.001").collect()] == [0, 0, 0]


def test_equal_shapes_are_worked_out_once(monkeypatch):
    """a shape was cut up anew wherever it lay."""
    import pyarrow as pa

    seen = []
    plain = wholes._levels_of
    monkeypatch.setattr(wholes, "_levels_of", lambda *a: seen.append(a) or plain(*a))
    shapes = [[(0, 0, _box(x, 3.0, x + w, 8.0))] for x, w in ((0.0, 2.0), (7.5, 2.0), (1e6, 2.0), (7.5, 3.0), (0.1, 2.0))]
    ring = lambda p, r, points: {"part": p, "ring": r, "points": [{"x": x, "y": y} for x, y in points]}
    marks = pa.array([None] * len(shapes), pa.list_(pa.struct([("part", pa.int32()), ("ring", pa.int32()), ("seq", pa.int32())])))
    rows = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(shapes))]), pa.array([[ring(*r) for r in s] for s in shapes], pa.list_(wholes._RING)), marks], names=["territory", "r", "f"])
    (got,) = wholes.whole_levels(iter([rows]), {"": 0.1}, 1e-9)
    assert len(seen) == 3  # the square that lies on no float keeps its place
    assert [[(p["x"], p["y"]) for p in r[0]["points"]] for r in got.column("rings").to_pylist()] == [s[0][2] for s in shapes]
    assert [a["output_area"] for a in got.column("account").to_pylist()] == pytest.approx([10.0, 10.0, 10.0, 15.0, 10.0])


@pytest.mark.parametrize(
    "rings, sound",
    [
        ([(0, 0, _box(0, 0, 9, 9)), (0, 1, _box(2, 2, 4, 4)), (1, 0, _box(2.5, 2.5, 3, 3)), (2, 0, _box(20, 0, 21, 1))], True),
        ([(0, 0, [(0, 0), (4, 4), (4, 0), (0, 4)])], False),  # crosses itself
        ([(0, 0, [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)])], False),  # touches itself
        ([(0, 0, [(0, 0), (4, 0), (6, 0), (4, 0), (4, 4)])], False),  # a spike
        ([(0, 0, [(0, 0), (2, 0), (4, 0), (4, 4)])], True),  # a flat corner
        ([(0, 0, _box(0, 0, 9, 9)), (0, 1, _box(7, 7, 11, 8))], False),
        ([(0, 0, _box(0, 0, 9, 9)), (0, 1, _box(12, 0, 13, 1))], False),
        ([(0, 0, _box(0, 0, 9, 9)), (0, 1, _box(2, 2, 8, 8)), (0, 2, _box(3, 3, 4, 4))], False),
        ([(0, 0, _box(0, 0, 9, 9)), (1, 0, _box(2, 2, 4, 4))], False),
        ([(0, 0, _box(0, 0, 9, 9)), (0, 1, _box(2, 2, 4, 1e-9 + 9))], False),
        ([(0, 0, _box(0, 0, 9, 9)), (0, 0, _box(20, 0, 21, 1))], False),
        ([], True),
    ],
)
def test_clearly_sound(rings, sound):
    assert wholes.clearly_sound([(p, r, np.array(points, float)) for p, r, points in rings], 1e-9) is sound


def test_fixed_vertices_in_one_shuffle(spark):
    """corners were shuffled five times to find those where borders meet."""
    rings = spark.createDataFrame([("a", 0, 0, _box(0.0, 0.0, 1.0, 1.0)), ("b", 0, 0, [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)]), ("c", 0, 0, [(5.0, 5.0), (6.0, 5.0)])], RINGS)
    fixed = mesh.fixed_vertices(rings)
    assert fixed._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, fixed.collect())) == [("a", 0, 0, 1), ("a", 0, 0, 2), ("b", 0, 0, 0), ("b", 0, 0, 3), ("c", 0, 0, 0), ("c", 0, 0, 1)]
