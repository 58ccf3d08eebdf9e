"""Triangulation of parts with many holes and of shapes that cross themselves."""

import random
from fractions import Fraction

import numpy as np
import pytest

from regionspark.operators import mesh


def _check(rings):
    rings = [np.array(r, float) for r in rings]
    t = mesh.triangulate_part(rings)
    xy = np.concatenate(rings)
    p = xy[t]
    area = mesh._cross(p[:, 0], p[:, 1], p[:, 2]) / 2
    assert (area > 0).all()
    assert area.sum() == pytest.approx(sum(mesh._ring_area(r) for r in rings), rel=1e-12)
    # no edge of the rings is cut, so each is a side of exactly one triangle, and no triangle covers another's middle
    sides = {(int(a), int(b)) for k in t for a, b in zip(k, np.roll(k, -1))}
    assert len(sides) == 3 * len(t)
    return t


def _hole(x0, y0, x1, y1):
    return [(x0, y0), (x0, y1), (x1, y1), (x1, y0)]


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


def test_two_holes_where_one_stands_in_the_way_of_the_other():
    assert len(_check([SQUARE, _hole(3.62, 3.71, 3.86, 4.43), _hole(1.58, 7.47, 2.20, 8.23)])) == 14


def test_random_holes():
    rng = random.Random(1)
    for _ in range(1000):
        holes = []
        for _ in range(rng.randrange(2, 12)):
            x, y, w, h = (round(rng.uniform(a, b), 2) for a, b in ((0.1, 9), (0.1, 9), (0.05, 0.9), (0.05, 0.9)))
            if all(x + w < a or x > c or y + h < b or y > d for a, b, c, d in holes):
                holes.append((x, y, round(x + w, 2), round(y + h, 2)))
        t = _check([SQUARE, *[_hole(*h) for h in holes]])
        assert len(t) == 4 + 4 * len(holes) + 2 * len(holes) - 2


def test_holes_that_touch_the_border_or_each_other():
    _check([SQUARE, [(0, 5), (2, 6), (2, 4)]])
    _check([SQUARE, [(10, 5), (8, 4), (8, 6)]])
    _check([SQUARE, _hole(2, 2, 4, 4), _hole(4, 4, 6, 6)])


def _crosses(r):
    r = [(Fraction(x), Fraction(y)) for x, y in r]
    side = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    e = [(r[i - 1], r[i]) for i in range(len(r))]
    return any(side(a, b, p) * side(a, b, q) < 0 and side(p, q, a) * side(p, q, b) < 0 for i, (a, b) in enumerate(e) for p, q in e[:i])


def test_crossing_rings_are_losses_and_others_are_not():
    rng = random.Random(2)
    assert mesh._built([np.array([(2, 7), (5, 2), (8, 3), (1, 3), (8, 1)], float)])[2][0][0] == "skipped_part"
    crossing = sound = 0
    for _ in range(2000):
        r = [(rng.randrange(10), rng.randrange(10)) for _ in range(rng.randrange(4, 8))]
        if len(set(r)) < len(r):
            continue
        kept, t, lost = mesh._built([np.array(r, float)])
        if _crosses(r):
            crossing += 1
            assert [k for k, _, _ in lost] == ["skipped_part"] and not len(t)
        elif kept and not lost:
            sound += 1
            p = np.concatenate(kept)[t]
            assert (mesh._cross(p[:, 0], p[:, 1], p[:, 2]) > 0).all()
    assert crossing > 500 and sound > 100


def test_a_long_ring_is_checked_in_blocks():
    n = 20_000
    zigzag = [(k, (k % 2) * 0.5) for k in range(n)] + [(n - 1, 5), (0, 5)]
    assert not mesh._cross_each_other([np.array(zigzag, float)])
    zigzag[n // 2] = (n // 2, 7)
    assert mesh._cross_each_other([np.array(zigzag, float)])
