"""Repair, union, gaps and validity against slab-by-slab brute force in exact fractions."""

import itertools
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from regionspark.operators import edges, grid, overlay

RING = "points array<struct<x:double,y:double>>"


def _edges(ring):
    return [(ring[i], ring[(i + 1) % len(ring)]) for i in range(len(ring)) if ring[i] != ring[(i + 1) % len(ring)]]


def slab_area(owners):
    """The area of the union of even-odd surfaces, each given as rings: between neighbouring x of vertices and crossings, edges don't cross."""
    lines = [(k, tuple(map(Fraction, a)), tuple(map(Fraction, b))) for k, rings in enumerate(owners) for r in rings for a, b in _edges(r)]
    xs = {p[0] for _, a, b in lines for p in (a, b)}
    for (_, a, b), (_, c, d) in itertools.combinations(lines, 2):
        det = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
        if det:
            t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / det
            xs.add(a[0] + t * (b[0] - a[0]))
    total = Fraction(0)
    xs = sorted(xs)
    for x0, x1 in zip(xs, xs[1:]):
        mid = (x0 + x1) / 2
        at = sorted((a[1] + (mid - a[0]) * (b[1] - a[1]) / (b[0] - a[0]), k) for k, a, b in lines if min(a[0], b[0]) < mid < max(a[0], b[0]))
        odd = set()
        for (y, k), (y2, _) in zip(at, at[1:]):
            odd ^= {k}
            if odd:
                total += (y2 - y) * (x1 - x0)
    return total


def _rows(spark, groups):
    return spark.createDataFrame([(g, [(float(x), float(y)) for x, y in r]) for g, rings in groups.items() for r in rings], f"grp string, {RING}")


def _check_parts(rows):
    """Parts are simple rings, exteriors counter-clockwise, holes clockwise; per group area and number of parts and holes."""
    out = defaultdict(lambda: [0.0, 0, 0])
    for r in rows:
        for k, ring in enumerate(r["rings"]):
            points = [(p["x"], p["y"]) for p in ring]
            assert len(set(points)) == len(points) >= 3
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in _edges(points)) / 2
            assert (area > 0) == (k == 0)
            out[r["grp"]][0] += area
        out[r["grp"]][1] += 1
        out[r["grp"]][2] += len(r["rings"]) - 1
    return out


KNOWN = {
    "bow tie": ([[(0, 0), (4, 4), (4, 0), (0, 4)]], 8, 2, 0),
    "spike": ([[(0, 0), (4, 0), (4, 4), (4, 9), (4, 4), (0, 4)]], 16, 1, 0),
    "doubled": ([[(0, 0), (4, 0), (4, 4), (0, 4)] * 2 + [(0, 0)]], 16, 1, 0),
    "same ring twice": ([[(0, 0), (4, 0), (4, 4), (0, 4)], [(4, 4), (0, 4), (0, 0), (4, 0)]], 16, 1, 0),
    "touching squares": ([[(0, 0), (2, 0), (2, 2), (0, 2)], [(2, 2), (4, 2), (4, 4), (2, 4)]], 8, 2, 0),
    "side by side": ([[(0, 0), (2, 0), (2, 2), (0, 2)], [(2, 0), (4, 0), (4, 2), (2, 2)]], 8, 1, 0),
    "overlapping": ([[(0, 0), (3, 0), (3, 3), (0, 3)], [(1, 1), (4, 1), (4, 4), (1, 4)]], 10, 2, 0),
    "hole": ([[(0, 0), (9, 0), (9, 9), (0, 9)], [(1, 1), (2, 1), (2, 2), (1, 2)], [(4, 4), (8, 4), (8, 8), (4, 8)], [(5, 5), (7, 5), (7, 7), (5, 7)]], 81 - 1 - 16 + 4, 2, 2),
    "hole outside": ([[(0, 0), (2, 0), (2, 2), (0, 2)], [(5, 5), (6, 5), (6, 6), (5, 6)]], 5, 2, 0),
    "hole across the border": ([[(0, 0), (4, 0), (4, 4), (0, 4)], [(3, 1), (6, 1), (6, 2), (3, 2)]], 16 - 1 + 2, 2, 0),
    "hole that touches": ([[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 2), (1, 1), (2, 2), (1, 3)]], 14, 1, 1),
    "flat": ([[(0, 0), (3, 3), (6, 6)]], 0, 0, 0),
    "point": ([[(1, 1), (1, 1)]], 0, 0, 0),
    "none": ([[]], 0, 0, 0),
}


def test_surfaces_of_known_shapes(spark):
    got = _check_parts(overlay.surfaces(_rows(spark, {k: v[0] for k, v in KNOWN.items()})).collect())
    for name, (_, area, parts, holes) in KNOWN.items():
        assert (round(got[name][0], 9), *got[name][1:]) == (area, parts, holes), name


def test_surfaces_of_random_crossing_rings(spark):
    rng = random.Random(4)
    groups = {}
    for g in range(60):
        n, size = rng.randrange(3, 12), rng.choice([6, 1000])
        groups[f"g{g}"] = [[(rng.randrange(size), rng.randrange(size)) for _ in range(n)] for _ in range(rng.randrange(1, 4))]
    got = _check_parts(overlay.surfaces(_rows(spark, groups)).collect())
    for name, rings in groups.items():
        # the brute force counts an edge as often as it is there; equal rings are one
        want = float(slab_area([list({tuple(sorted(map(tuple, map(sorted, _edges(r))))): r for r in rings}.values())]))
        assert got[name][0] == pytest.approx(want, rel=1e-6, abs=1e-6), rings


def _boxes(rng, n, size):
    out = []
    for _ in range(n):
        x, y = rng.randrange(size), rng.randrange(size)
        out.append((x, y, x + rng.randrange(1, size), y + rng.randrange(1, size)))
    return out


def _box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_union_of_random_surfaces(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for g in range(40):
        owners = []
        for k, (x0, y0, x1, y1) in enumerate(_boxes(rng, rng.randrange(1, 7), 12)):
            shape = [_box(x0, y0, x1, y1)] if rng.random() < 0.6 else [[(x0, y0), (x1, y0 + 1), (x0 + 1, y1 + 1)]]
            if len(shape[0]) == 4 and x1 - x0 > 2 and y1 - y0 > 2:
                shape.append(_box(x0 + 1, y0 + 1, x1 - 1, y1 - 1))
            owners.append(shape)
            rows += [(f"g{g}", f"o{k}", 0, i, [(float(x), float(y)) for x, y in (r if rng.random() < 0.5 else r[::-1])]) for i, r in enumerate(shape)]
        want[f"g{g}"] = float(slab_area(owners))
    got = _check_parts(overlay.union(spark.createDataFrame(rows, f"grp string, owner string, part int, ring int, {RING}")).collect())
    for g, area in want.items():
        assert got[g][0] == pytest.approx(area, abs=1e-6), g


def test_rings_longer_than_a_cell_are_closed(spark):
    n = 3000
    zigzag = [(k, (k % 2) * 3) for k in range(n)] + [(n - 1, 10), (0, 10)]
    got = overlay.surfaces(_rows(spark, {"z": [zigzag], "s": [[(0, 0), (1, 0), (1, 1)]]}), quantum=1.0).where("grp = 'z'").collect()
    assert len(got) == 1 and len(got[0]["rings"]) == 1
    assert got[0]["area"] == float(slab_area([[zigzag]])) if n < 100 else len(got[0]["rings"][0]) == len(zigzag)


def test_pair_gaps(spark):
    ring = lambda t, i, r: (t, 0, i, [(float(x), float(y)) for x, y in r])
    rows = [
        ring("c", 0, [(0, 0), (9, 0), (9, 2), (2, 2), (2, 4), (9, 4), (9, 6), (0, 6)]),  # an open bracket
        ring("lid", 0, _box(9, 0, 10, 6)),
        ring("far", 0, _box(20, 0, 30, 9)),
        ring("far", 1, _box(22, 2, 25, 5)),
    ]
    rings = spark.createDataFrame(rows, f"territory string, part int, ring int, {RING}")
    pairs = spark.createDataFrame([("c", "lid"), ("c", "far"), ("far", "lid")], "left string, right string")
    assert {tuple(r) for r in overlay.pair_gaps(rings, pairs).collect()} == {("c", "lid", 14.0), ("c", "far", 0.0), ("far", "lid", 0.0)}


def test_neighbours_across_t_junctions(spark):
    rows = [("big", 0, 0, _box(0, 0, 4, 4)), ("a", 0, 0, _box(4, 0, 6, 1)), ("b", 0, 0, _box(4, 1, 6, 4)), ("c", 0, 0, _box(4, 4, 6, 6)), ("tilted", 0, 0, [(6, 0), (9, 3), (6, 6)])]
    rings = spark.createDataFrame([(t, p, r, [(float(x), float(y)) for x, y in s]) for t, p, r, s in rows], f"territory string, part int, ring int, {RING}")
    got = {(r["left"], r["right"]): r["length"] for r in edges.neighbours(overlay.noded_rings(rings)).collect()}
    assert got == {("a", "big"): 1.0, ("b", "big"): 3.0, ("a", "b"): 2.0, ("b", "c"): 2.0, ("a", "tilted"): 1.0, ("b", "tilted"): 3.0, ("c", "tilted"): 2.0}


def test_ring_faults(spark):
    square, far = _box(0, 0, 10, 10), _box(20, 20, 30, 30)
    shapes = {
        "sound": [(0, 0, square), (0, 1, _box(1, 1, 2, 2)), (0, 2, _box(4, 4, 5, 5)), (1, 0, far)],
        "island": [(0, 0, square), (0, 1, _box(2, 2, 8, 8)), (1, 0, _box(4, 4, 5, 5))],
        "touching hole": [(0, 0, square), (0, 1, [(0, 5), (2, 4), (2, 6)])],
        "tie": [(0, 0, [(0, 0), (4, 4), (4, 0), (0, 4)]), (1, 0, far)],
        "touches itself": [(0, 0, [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)])],
        "spike": [(0, 0, [(0, 0), (4, 0), (4, 4), (4, 9), (4, 4), (0, 4)])],
        "crossing hole": [(0, 0, square), (0, 1, _box(8, 8, 12, 12))],
        "shared side": [(0, 0, square), (1, 0, _box(10, 2, 12, 8))],
        "outside": [(0, 0, square), (0, 1, _box(40, 40, 41, 41))],
        "nested": [(0, 0, square), (0, 1, _box(1, 1, 8, 8)), (0, 2, _box(2, 2, 3, 3))],
        "overlap": [(0, 0, square), (1, 0, _box(2, 2, 3, 3))],
    }
    rows = [(t, p, r, [(float(x), float(y)) for x, y in [*s, s[0]]]) for t, rings in shapes.items() for p, r, s in rings]
    got = {tuple(r) for r in overlay.ring_faults(spark.createDataFrame(rows, f"territory string, part int, ring int, {RING}")).collect()}
    assert got == {
        ("tie", 0, 0, "self_crossing"), ("touches itself", 0, 0, "self_crossing"), ("spike", 0, 0, "self_crossing"), ("crossing hole", 0, 1, "rings_cross"),
        ("shared side", 1, 0, "rings_cross"), ("outside", 0, 1, "hole_outside"), ("nested", 0, 2, "nested_holes"), ("overlap", 1, 0, "parts_overlap"),
    }


def test_level_join_is_the_theta_join(spark):
    rng = random.Random(9)
    box = lambda k, s: (k, (x := rng.uniform(-50, 50)), (y := rng.uniform(-50, 50)), x + rng.choice([0, 0.01, 1, 40]) * s, y + rng.choice([0, 0.2, 3]) * s)
    left, right = [box(k, 1) for k in range(150)] + [(999, -200.0, -200.0, 200.0, 200.0)], [box(k, 2) for k in range(150)]
    schema = "k int, min_x double, min_y double, max_x double, max_y double"
    got = Counter((r["l_k"], r["r_k"]) for r in grid.level_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect())
    want = Counter((a[0], b[0]) for a in left for b in right if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2])
    assert got == want and len(want) > 200
