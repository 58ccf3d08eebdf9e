"""Triangulation, triangle overlaps and arc-shared simplification: small kernels under Spark's distribution."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._store import expanded, spread, stored
from . import edges as E

#: Triangles of no more than this area (square metres) carry nothing.
MIN_AREA = 1e-9


def _cross(o, a, b):
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def _faces(poly: list[int], k: int, xy: np.ndarray, p: np.ndarray) -> bool:
    """Whether p lies in the interior angle of the corner k of a counter-clockwise polygon."""
    q, before, after = xy[poly[k]], xy[poly[k - 1]], xy[poly[(k + 1) % len(poly)]]
    left, right = _cross(q, after, p) >= 0, _cross(before, q, p) >= 0
    return bool(left and right if _cross(before, q, after) >= 0 else left or right)


def _bridge(outer: list[int], hole: list[int], xy: np.ndarray) -> list[int]:
    """outer with hole cut in from the hole's rightmost vertex m to an outer vertex that it sees on its right.

    Holes come by decreasing x, so whatever is not cut in yet lies on the left
    of m. A ray from m to the right meets an edge of outer; its end of greater
    x is visible unless a corner lies in the triangle between. Of such corners
    the one nearest in angle is.
    """
    h = max(range(len(hole)), key=lambda k: (xy[hole[k], 0], xy[hole[k], 1]))
    m = xy[hole[h]]
    a = xy[outer]
    b = np.roll(a, -1, axis=0)
    up = np.flatnonzero((a[:, 1] <= m[1]) & (b[:, 1] >= m[1]) & (a[:, 1] < b[:, 1]))
    x = a[up, 0] + (m[1] - a[up, 1]) * (b[up, 0] - a[up, 0]) / (b[up, 1] - a[up, 1])
    right = x >= m[0]
    if not right.any():
        raise ValueError("a hole lies outside")
    up, x = up[right], x[right]
    e = int(up[x == x.min()][np.argmax(np.maximum(a[up[x == x.min()], 0], b[up[x == x.min()], 0]))])
    hit = np.array([x.min(), m[1]])
    tip = a[e] if a[e, 0] > b[e, 0] else b[e]
    # corners in the triangle m, hit, tip, the tip among them
    u, v, w = (m, hit, tip) if _cross(m, hit, tip) >= 0 else (m, tip, hit)
    inside = (_cross(u, v, a) >= 0) & (_cross(v, w, a) >= 0) & (_cross(w, u, a) >= 0) & (a[:, 0] >= m[0]) | (a == tip).all(axis=1)
    at = np.flatnonzero(inside)
    d = a[at] - m
    far = (d * d).sum(axis=1)
    slope = np.abs(d[:, 1]) / np.where(d[:, 0] > 0, d[:, 0], np.where(far == 0, 1.0, 1e-300))
    for k in at[np.lexsort((far, slope))].tolist():
        if _faces(outer, k, xy, m):
            return outer[: k + 1] + hole[h:] + hole[: h + 1] + outer[k:]
    raise ValueError("a hole sees no outer vertex")


def _in_cycle(before, after, p, q) -> bool:
    """Whether, going around, exactly one of the directions p and q lies between before and after."""
    turn = lambda v: math.atan2(v[1], v[0])
    a = turn(before)
    to = lambda v: (turn(v) - a) % (2 * math.pi)
    return (to(p) < to(after)) != (to(q) < to(after))


def _cross_each_other(rings: list[np.ndarray]) -> bool:
    """Whether edges of a part's rings cross, overlap, or pass through each other in a vertex; touching is no crossing.

    All pairs of edges are held together in blocks: of small parts at once, of
    long ones sorted by x, so that an edge meets those only that begin before it ends.
    """
    a = np.concatenate(rings)
    b = np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    p = np.concatenate([np.roll(r, 1, axis=0) for r in rings])  # what comes before a
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 0], kind="stable")
    a, b, p, low, high = a[order], b[order], p[order], low[order], high[order]
    ends = np.searchsorted(low[:, 0], high[:, 0], "right")
    n, i = len(a), 0
    while i < n:
        # a block of edges against all that begin before the last of them ends
        size = max(1, min(n - i, (1 << 20) // max(1, int(ends[i : i + 64].max()) - i)))
        rows = np.arange(i, min(i + size, n))
        cols = np.arange(i, int(ends[rows].max()))
        near = (low[rows, None, 1] <= high[None, cols, 1]) & (high[rows, None, 1] >= low[None, cols, 1]) & (low[None, cols, 0] <= high[rows, None, 0]) & (rows[:, None] < cols[None, :])
        s, t = np.nonzero(near)
        s, t = rows[s], cols[t]
        d1, d2, d3, d4 = _cross(a[s], b[s], a[t]), _cross(a[s], b[s], b[t]), _cross(a[t], b[t], a[s]), _cross(a[t], b[t], b[s])
        if ((d1 * d2 < 0) & (d3 * d4 < 0)).any():
            return True
        line = (d1 == 0) & (d2 == 0)
        if line.any():
            d = b[s[line]] - a[s[line]]
            along = [((x[t[line]] - a[s[line]]) * d).sum(axis=1) for x in (a, b)]
            if (np.minimum(np.maximum(*along), (d * d).sum(axis=1)) > np.maximum(np.minimum(*along), 0)).any():
                return True
        for e, v, side in ((s, t, d1), (t, s, d3)):  # the vertex a[v] inside the edge e: do its neighbours lie on both sides?
            inner = (side == 0) & ~(a[v] == a[e]).all(axis=1) & ~(a[v] == b[e]).all(axis=1)
            for f, k in zip(e[inner].tolist(), v[inner].tolist()):
                if _cross(a[f], b[f], p[k]) * _cross(a[f], b[f], b[k]) < 0:
                    return True
        for f, k in zip(*(x[(a[s] == a[t]).all(axis=1)].tolist() for x in (s, t))):  # two corners in one point
            if _in_cycle(p[f] - a[f], b[f] - a[f], p[k] - a[k], b[k] - a[k]):
                return True
        i += size
    return False


class _Reflex:
    """Corners of a polygon that are not convex, by grid cell: the only ones that can lie in an ear."""

    def __init__(self, x: list[float], y: list[float], members: list[int]):
        self.x, self.y = x, y
        self.x0, self.y0 = min(x), min(y)
        self.n = max(1, math.isqrt(len(members) // 2))
        self.wx = (max(x) - self.x0) / self.n or 1.0
        self.wy = (max(y) - self.y0) / self.n or 1.0
        self.cells: dict[tuple[int, int], set[int]] = {}
        for k in members:
            self.cells.setdefault(self._cell(x[k], y[k]), set()).add(k)

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return min(int((x - self.x0) / self.wx), self.n - 1), min(int((y - self.y0) / self.wy), self.n - 1)

    def discard(self, k: int) -> None:
        self.cells.get(self._cell(self.x[k], self.y[k]), set()).discard(k)

    def any_inside(self, i: int, j: int, m: int) -> bool:
        """Whether one lies in the counter-clockwise triangle, or on its border, and is none of its corners."""
        x, y = self.x, self.y
        ax, ay, bx, by, cx, cy = x[i], y[i], x[j], y[j], x[m], y[m]
        (u0, v0), (u1, v1) = self._cell(min(ax, bx, cx), min(ay, by, cy)), self._cell(max(ax, bx, cx), max(ay, by, cy))
        for u in range(u0, u1 + 1):
            for v in range(v0, v1 + 1):
                for k in self.cells.get((u, v), ()):
                    px, py = x[k], y[k]
                    if (bx - ax) * (py - ay) - (by - ay) * (px - ax) < 0 or (cx - bx) * (py - by) - (cy - by) * (px - bx) < 0 or (ax - cx) * (py - cy) - (ay - cy) * (px - cx) < 0:
                        continue
                    if not (px == ax and py == ay or px == bx and py == by or px == cx and py == cy):
                        return True
        return False


def _convex(xy: np.ndarray) -> bool:
    """Whether a ring turns left at every corner and goes around once."""
    after = np.roll(xy, -1, axis=0)
    if not (_cross(np.roll(xy, 1, axis=0), xy, after) > 0).all():
        return False
    goes = np.sign(after[:, 0] - xy[:, 0])
    goes = goes[goes != 0]
    return int((goes != np.roll(goes, 1)).sum()) == 2


def triangulate_part(rings: list[np.ndarray]) -> np.ndarray:
    """Triangles (k, 3) over the vertices of all rings in order; ring 0 counter-clockwise, holes clockwise.

    A convex ring is a fan. Else ears are cut one by one; a corner is looked at
    again only when a neighbour has gone, and only corners that are not convex,
    found by grid cell, are tested against it. A shape whose edges cross or
    overlap, or that has corners left but no ear, is a ValueError.
    """
    xy = np.concatenate(rings)
    starts = np.cumsum([0, *map(len, rings)])
    poly = list(range(len(rings[0])))
    if len(rings) == 1 and _convex(xy):
        k = np.arange(1, len(xy) - 1)
        return np.stack([np.zeros_like(k), k, k + 1], axis=1)
    if _cross_each_other(rings):
        raise ValueError("the shape crosses itself")
    holes = [list(range(starts[i], starts[i + 1])) for i in range(1, len(rings))]
    for h in sorted(holes, key=lambda r: -xy[r, 0].max()):
        poly = _bridge(poly, h, xy)
    n = len(poly)
    x, y = xy[poly, 0].tolist(), xy[poly, 1].tolist()
    after, before = [*range(1, n), 0], [n - 1, *range(n - 1)]

    def turn(k: int) -> float:
        i, m = before[k], after[k]
        return (x[k] - x[i]) * (y[m] - y[i]) - (y[k] - y[i]) * (x[m] - x[i])

    reflex = _Reflex(x, y, [k for k in range(n) if turn(k) <= 0])
    out, k, left, idle = [], 0, n, 0
    while left > 3:
        i, m, area = before[k], after[k], turn(k)
        if area > 0 and not reflex.any_inside(i, k, m):
            out.append((poly[i], poly[k], poly[m]))
        elif not (area == 0 and idle > left):  # a flat corner goes only if nothing else does
            if idle > 2 * left:
                raise ValueError("the shape crosses itself")
            k, idle = m, idle + 1
            continue
        reflex.discard(k)
        after[i], before[m] = m, i
        left, idle = left - 1, 0
        for c in (i, m):
            if turn(c) > 0:
                reflex.discard(c)
        k = i
    if turn(k) != 0:
        if turn(k) < 0:
            raise ValueError("the shape crosses itself")
        out.append((poly[before[k]], poly[k], poly[after[k]]))
    return np.array(out, np.int64).reshape(-1, 3)


def _prepared(points: np.ndarray, counter_clockwise: bool) -> np.ndarray | None:
    """Open, in storage precision, without repeats, wound as asked; None if fewer than 3 vertices or no area is left."""
    p = points.astype(np.float32).astype(np.float64)
    if len(points) > 1 and (points[0] == points[-1]).all():
        p = p[:-1]
    if len(p):
        p = p[(p != np.roll(p, -1, axis=0)).any(axis=1)]
    if len(p) < 3:
        return None
    area = _ring_area(p)
    if area == 0:
        return None
    return p if (area > 0) == counter_clockwise else p[::-1]


def _ring_area(p: np.ndarray) -> float:
    n = np.roll(p, -1, axis=0)
    return float((p[:, 0] * n[:, 1] - n[:, 0] * p[:, 1]).sum()) / 2 if len(p) else 0.0


def _built(rings: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, list[tuple[str, int, float]]]:
    """(prepared rings, triangles, losses as kind, count, area) of one part."""
    outer = _prepared(rings[0], True) if rings else None
    if outer is None:
        return [], np.zeros((0, 3), np.int64), [("skipped_part", 1, abs(_ring_area(rings[0])) if rings else 0.0)]
    kept, losses = [outer], []
    for r in rings[1:]:
        hole = _prepared(r, False)
        if hole is None:
            losses.append(("skipped_ring", 1, abs(_ring_area(r))))
        else:
            kept.append(hole)
    try:
        t = triangulate_part(kept)
    except ValueError:
        return [], np.zeros((0, 3), np.int64), [("skipped_part", 1, abs(_ring_area(outer)))]
    p = np.concatenate(kept)[t]
    area = np.abs(_cross(p[:, 0], p[:, 1], p[:, 2])) / 2
    flat = area <= MIN_AREA
    if flat.any():
        losses.append(("degenerate_triangle", int(flat.sum()), float(area[flat].sum())))
    return kept, t[~flat], losses


_POINT = "struct<x:double,y:double>"
BUILT = f"territory string, part int, rings array<array<{_POINT}>>, triangles array<int>, losses array<struct<kind:string,count:bigint,area:double>>"


def build(parts: DataFrame) -> DataFrame:
    """territory, part, rings (array of rings of points, the exterior first) -> prepared rings, triangles and typed losses, a row per part.

    triangles are indices into the part's prepared vertices, three by three. A
    part whose exterior has no area left, or that crosses itself, becomes a
    loss skipped_part and has no triangles; a hole without area a skipped_ring;
    triangles of no more than MIN_AREA are counted as degenerate_triangle. Null
    and empty rings are skipped parts or rings, too. Rows are parts, so a
    territory with many parts is spread over tasks; equal shapes that meet in a
    task are cut up once.
    """
    ring_type = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    loss_type = pa.list_(pa.struct([("kind", pa.string()), ("count", pa.int64()), ("area", pa.float64())]))

    def run(batches):
        known: dict[tuple, tuple] = {}
        for b in batches:
            col = b.column(2)
            flat = col.values.values
            xy = np.stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)], axis=1).astype(float) if len(flat) else np.zeros((0, 2))
            ends, inner = col.offsets.to_pylist(), col.values.offsets.to_pylist()
            shapes, triangles, losses = [], [], []
            for k in range(b.num_rows):
                rings = [xy[inner[r] : inner[r + 1]] for r in range(ends[k], ends[k + 1])]
                shape = tuple(r.tobytes() for r in rings)
                if shape not in known:
                    if len(known) >= 1024 or sum(map(len, shape)) > 1 << 16:  # what is kept is a few dozen MB at most
                        known.clear()
                    known[shape] = _built(rings)
                kept, t, lost = known[shape]
                shapes.append(kept)
                triangles.append(t.astype(np.int32).ravel())
                losses.append([{"kind": x, "count": n, "area": a} for x, n, a in lost])
            points = np.concatenate([r for s in shapes for r in s]) if any(shapes) else np.zeros((0, 2))
            pts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, i])) for i in range(2)], ["x", "y"])
            rings_of = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r) for s in shapes for r in s)]), pa.int32()), pts)
            parts_of = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, shapes)]), pa.int32()), rings_of)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), parts_of.cast(ring_type), pa.array(triangles, pa.list_(pa.int32())), pa.array(losses, loss_type)], names=["territory", "part", "rings", "triangles", "losses"])

    none = F.array().cast(f"array<{_POINT}>")
    rings = F.coalesce(F.transform("rings", lambda r: F.filter(F.coalesce(r, none), lambda p: p.isNotNull())), F.array().cast(f"array<array<{_POINT}>>"))
    return spread(parts.select(F.col("territory").cast("string"), F.col("part").cast("int"), rings.alias("rings"))).mapInArrow(run, BUILT)


def triangles(built: DataFrame) -> DataFrame:
    """A row per triangle of build()'s parts: its number, corners' indices in the part, and corners."""
    v = F.flatten("rings")
    t = built.select("territory", "part", v.alias("v"), "triangles", F.explode(F.when(F.size("triangles") > 0, F.sequence(F.lit(0), F.size("triangles") - 1, F.lit(3)))).alias("i"))
    at = [F.get("triangles", F.col("i") + k) for k in range(3)]
    t = t.select("territory", "part", F.floor(F.col("i") / 3).alias("tri"), *[i.cast("long").alias(n) for i, n in zip(at, "abc")], *[F.get("v", i).alias(f"p{n}") for i, n in zip(at, "abc")])
    return t.select("territory", "part", "tri", "a", "b", "c", *[F.col(f"p{n}.{z}").alias(f"{n}{z}") for n in "abc" for z in "xy"])


def triangulate(parts: DataFrame) -> DataFrame:
    """territory, part, rings -> a row per triangle, as triangles(build(parts))."""
    return triangles(build(parts))


def triangulation_events(built: DataFrame) -> DataFrame:
    """territory, stage, kind, count, area, details: what build() lost, by territory and kind; nothing where nothing was."""
    lost = built.select("territory", F.inline("losses"))
    none = F.array().cast("array<string>").alias("details")
    return lost.groupBy("territory", "kind").agg(F.sum("count").alias("count"), F.sum("area").alias("area")).select("territory", F.lit("triangulation").alias("stage"), "kind", "count", "area", none)


def empty_parts(built: DataFrame) -> DataFrame:
    """territory, part of parts that have vertices but no triangle."""
    return built.where((F.size("rings") > 0) & (F.size("triangles") == 0)).select("territory", "part")


def part_owners(built: DataFrame) -> DataFrame:
    """territory, tri, part, vertex: the part in whose range of the territory's vertices each triangle's first corner lies.

    A territory's mesh has its parts' vertices end to end. Where ranges start
    comes from running sums; each vertex number then takes the last start at or
    before it, in one pass over starts and vertices in order.
    """
    per = built.select("territory", "part", F.size(F.flatten("rings")).alias("n"), "triangles", F.floor(F.size("triangles") / 3).alias("t"))
    before = Window.partitionBy("territory").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = per.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("first", F.coalesce(F.sum("t").over(before), F.lit(0)))
    corner = F.filter("triangles", lambda v, k: k % 3 == 0)
    vertices = sums.select("territory", "base", "first", F.posexplode(corner).alias("k", "v")).select("territory", (F.col("base") + F.col("v")).alias("vertex"), (F.col("first") + F.col("k")).alias("tri"), F.lit(None).cast("int").alias("starts"))
    starts = sums.where("n > 0").select("territory", F.col("base").alias("vertex"), F.lit(None).cast("long").alias("tri"), F.col("part").alias("starts"))
    so_far = Window.partitionBy("territory").orderBy("vertex", F.col("tri").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = vertices.unionByName(starts).withColumn("part", F.last("starts", ignorenulls=True).over(so_far))
    return both.where("tri IS NOT NULL").select("territory", "tri", "part", "vertex")


def owning_triangles(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """points' columns, territory, part, tri: of each part that holds a point (min_x = max_x, min_y = max_y) the least triangle that touches it.

    Triangles tile their part, so a point lies in one of them, or on a border
    of several; the rule gives it one owner. Boxes meet on grids of their own size.
    """
    from ..functions.rings import in_triangle
    from .grid import aspect, level_join

    xs, ys = ("ax", "bx", "cx"), ("ay", "by", "cy")
    boxed = triangles.withColumns({"min_x": F.least(*xs), "max_x": F.greatest(*xs), "min_y": F.least(*ys), "max_y": F.greatest(*ys)})
    hit = level_join(points, boxed, aspect=aspect(boxed)).where(in_triangle(F.col("l_min_x"), F.col("l_min_y"), *[F.col(f"r_{c}{z}") for c in "abc" for z in "xy"]))
    return hit.groupBy(*[F.col(f"l_{c}").alias(c) for c in points.columns], F.col("r_territory").alias("territory"), F.col("r_part").alias("part")).agg(F.min("r_tri").alias("tri"))


def clip_areas(t: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The areas that pairs of triangles (n, 3, 2) share: one is cut by the half planes of the other, all pairs at once."""
    turned = _cross(u[:, 0], u[:, 1], u[:, 2]) < 0
    u = np.where(turned[:, None, None], u[:, ::-1], u)
    poly, n = t, np.full(len(t), 3)
    for k in range(3):
        a, b = u[:, None, k], u[:, None, (k + 1) % 3]
        m = np.arange(poly.shape[1])
        held = m < n[:, None]
        last = np.maximum(n - 1, 0)[:, None]
        before = np.take_along_axis(poly, np.where(m == 0, last, m - 1)[..., None], axis=1)
        dp, dq = _cross(a, b, before), _cross(a, b, poly)
        crosses = held & ((dp >= 0) != (dq >= 0))
        share = dp / np.where(crosses, dp - dq, 1.0)
        made = np.stack([before + (poly - before) * share[..., None], poly], axis=2).reshape(len(t), -1, 2)
        keep = np.stack([crosses, held & (dq >= 0)], axis=2).reshape(len(t), -1)
        order = np.argsort(~keep, axis=1, kind="stable")
        n = keep.sum(axis=1)
        poly = np.take_along_axis(made, order[..., None], axis=1)[:, : max(3, int(n.max(initial=0)))]
    m = np.arange(poly.shape[1])
    after = np.take_along_axis(poly, np.where(m + 1 >= n[:, None], 0, m + 1)[..., None], axis=1)
    terms = poly[..., 0] * after[..., 1] - after[..., 0] * poly[..., 1]
    return np.where(n >= 3, np.abs(np.where(m < n[:, None], terms, 0.0).sum(axis=1)) / 2, 0.0)


def clip_area(t: np.ndarray, u: np.ndarray) -> float:
    """The area that two triangles (3, 2) share."""
    return float(clip_areas(t[None], u[None])[0])


def triangle_overlaps(left: DataFrame, right: DataFrame, cell: float | None = None, pairs: str = "true") -> DataFrame:
    """l_territory, l_part, r_territory, r_part, area > 0 over two sets of triangles; of pairs for which the condition `pairs` on these names holds.

    Triangles tile their polygons, so the shares of pairs add up to the
    polygons' overlap. Pairs come from the grid join with that cell, or else on
    grids of their own sizes and usual shape.
    """
    from .grid import aspect, box_join, level_join

    corners = ["ax", "ay", "bx", "by", "cx", "cy"]
    xs, ys = ("ax", "bx", "cx"), ("ay", "by", "cy")
    boxed = lambda df: df.select("territory", "part", *corners, F.least(*xs).alias("min_x"), F.greatest(*xs).alias("max_x"), F.least(*ys).alias("min_y"), F.greatest(*ys).alias("max_y"))
    a, b = boxed(left), boxed(right)
    met = box_join(a, b, cell) if cell else level_join(a, b, aspect=aspect(a))
    met = met.where(pairs)

    areas = met.select("l_territory", "l_part", "r_territory", "r_part", *[f"{s}_{c}" for s in "lr" for c in corners]).mapInArrow(_clipped, "l_territory string, l_part int, r_territory string, r_part int, area double")
    return areas.groupBy("l_territory", "l_part", "r_territory", "r_part").agg(F.sum("area").alias("area")).where("area > 0")


def shapes(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(territory, part, class: parts with the same rings have one; territory, part, rings of the classes: a class is the territory)."""
    named = stored(parts.select(F.col("territory").cast("string"), F.col("part").cast("int"), "rings", F.sha2(F.to_json(F.struct("rings")), 256).alias("class")), "shapes")
    once = named.groupBy("class").agg(F.first("rings").alias("rings"))
    return named.drop("rings"), once.select(F.col("class").alias("territory"), F.lit(0).alias("part"), "rings")


def part_overlaps(parts: DataFrame) -> DataFrame:
    """left, left_part, right, right_part, area > 0 that parts (territory, part, rings) of two territories share, left < right.

    Equal shapes are triangulated and overlaid once, and pairs of shapes are then written out by part.
    """
    named, once = shapes(parts)
    t = stored(triangulate(once), "shape-triangles")
    shared = triangle_overlaps(t, t, pairs="l_territory <= r_territory").select(F.col("l_territory").alias("l_class"), F.col("r_territory").alias("r_class"), "area")
    met = expanded(shared, named.select("class", F.struct("territory", "part").alias("member")))
    met = met.where("l.territory <> r.territory AND (l_class <> r_class OR l.territory < r.territory)")
    return met.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), "area").select(F.col("a.territory").alias("left"), F.col("a.part").alias("left_part"), F.col("b.territory").alias("right"), F.col("b.part").alias("right_part"), "area")


def _clipped(batches):
    corners = ["ax", "ay", "bx", "by", "cx", "cy"]
    for b in batches:
        t = np.stack([b.column(f"l_{c}").to_numpy() for c in corners], axis=1).reshape(-1, 3, 2)
        u = np.stack([b.column(f"r_{c}").to_numpy() for c in corners], axis=1).reshape(-1, 3, 2)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(clip_areas(t, u), pa.float64())], names=["l_territory", "l_part", "r_territory", "r_part", "area"])


def territory_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """territory, l_part, r_part, area > 0: what parts of the same territory share over two sets of triangles.

    Triangles meet by territory on grids of their own size, so neither a
    territory of many parts nor one huge part compares all with all.
    """
    from .grid import level_join

    corners = ["ax", "ay", "bx", "by", "cx", "cy"]
    xs, ys = ("ax", "bx", "cx"), ("ay", "by", "cy")
    boxed = lambda df: df.select("territory", "part", *corners, F.least(*xs).alias("min_x"), F.greatest(*xs).alias("max_x"), F.least(*ys).alias("min_y"), F.greatest(*ys).alias("max_y"))
    pairs = level_join(boxed(left), boxed(right), ("territory",))
    pairs = pairs.select(F.col("territory").alias("l_territory"), "l_part", F.col("territory").alias("r_territory"), "r_part", *[f"{s}_{c}" for s in "lr" for c in corners])
    areas = pairs.mapInArrow(_clipped, "l_territory string, l_part int, r_territory string, r_part int, area double")
    return areas.groupBy(F.col("l_territory").alias("territory"), "l_part", "r_part").agg(F.sum("area").alias("area")).where("area > 0")


def _thin(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on an open line: which points stay."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        s, e = todo.pop()
        if e - s < 2:
            continue
        a, d = points[s], points[e] - points[s]
        rel = points[s + 1 : e] - a
        long = float(d @ d)
        t = np.clip(rel @ d / long, 0, 1) if long else np.zeros(len(rel))
        gap = ((rel - t[:, None] * d) ** 2).sum(axis=1)
        k = int(gap.argmax())
        if gap[k] > tolerance * tolerance:
            keep[s + 1 + k] = True
            todo += [(s, s + 1 + k), (s + 1 + k, e)]
    return keep


def _arc(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of one arc stay, thinned in the direction that both of its rings agree on."""
    back = tuple(points[-1]) < tuple(points[0]) or (tuple(points[-1]) == tuple(points[0]) and tuple(points[-2]) < tuple(points[1]))
    line = points[::-1] if back else points
    if len(line) > 3 and (line[0] == line[-1]).all():
        far = int(((line - line[0]) ** 2).sum(axis=1).argmax())
        keep = np.concatenate([_thin(line[: far + 1], tolerance), _thin(line[far:], tolerance)[1:]])
    else:
        keep = _thin(line, tolerance)
    return keep[::-1] if back else keep


def kept_of_ring(points: np.ndarray, fixed: np.ndarray, tolerance: float) -> np.ndarray:
    """The numbers, in order, of the vertices that stay of an open ring with its arcs between fixed vertices thinned; without any it starts at its least vertex."""
    at = np.flatnonzero(fixed)
    if not len(at):
        at = np.array([min(range(len(points)), key=lambda k: tuple(points[k]))])
    order = np.arange(at[0], at[0] + len(points) + 1) % len(points)
    ring = points[order]
    cuts = [*(at - at[0]).tolist(), len(points)]
    return np.concatenate([order[s:e][_arc(ring[s : e + 1], tolerance)[:-1]] for s, e in zip(cuts, cuts[1:])])


def simplify_ring(points: np.ndarray, fixed: np.ndarray, tolerance: float) -> np.ndarray:
    """An open ring with its arcs between fixed vertices thinned."""
    return points[kept_of_ring(points, fixed, tolerance)]


def fixed_vertices(rings: DataFrame) -> DataFrame:
    """territory, part, ring, seq of vertices that the union of all borders does not simply pass through: they have other than two neighbours.

    All corners at a vertex meet in one shuffle, and only those of fixed vertices leave it.
    """
    n = F.size("points")
    before, after = F.concat(F.slice("points", n, F.lit(1)), F.slice("points", F.lit(1), n - 1)), F.concat(F.slice("points", F.lit(2), n - 1), F.slice("points", 1, 1))
    corners = rings.where(n > 0).select("territory", "part", "ring", F.posexplode(F.arrays_zip(F.col("points").alias("p"), before.alias("a"), after.alias("b"))).alias("seq", "c"))
    key = lambda end: E.point_key(F.col(f"c.{end}.x"), F.col(f"c.{end}.y"))
    corners = corners.select("territory", "part", "ring", "seq", F.col("c.p.x").alias("x"), F.col("c.p.y").alias("y"), key("a").alias("a"), key("b").alias("b"))
    corners = corners.select("territory", "part", "ring", "seq", "x", "y", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    here = Window.partitionBy("x", "y")
    held = corners.withColumns({"least": F.min("low").over(here), "most": F.max("high").over(here)})
    # two neighbours: the least and the greatest of all, and no other
    two = (F.col("least") < F.col("most")) & F.col("low").isin(F.col("least"), F.col("most")) & F.col("high").isin(F.col("least"), F.col("most"))
    return held.withColumn("passes", F.min(two).over(here)).where(~F.col("passes")).select("territory", "part", "ring", "seq")


def thin_levels(rings: DataFrame, tolerances: dict[str, float], fixed: DataFrame | None = None) -> DataFrame:
    """lod, territory, part, ring, points: rings (territory, part, ring, points: open) thinned to each tolerance so that shared borders stay shared.

    A vertex where the union of all borders does not simply pass through (other
    than two neighbours) is fixed. Between fixed vertices, rings that share a
    border hold the same points, and each thins them in the same direction: the
    results are identical without ever meeting. Rings may be left with fewer than
    three vertices. fixed: fixed_vertices, if rings are not all that there are.
    """
    fixed = fixed_vertices(rings) if fixed is None else fixed
    marks = fixed.groupBy("territory", "part", "ring").agg(F.collect_list("seq").alias("f"))
    marked = rings.where(F.size("points") > 0).join(marks.hint("merge"), ["territory", "part", "ring"], "left")

    def run(batches):
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
        for b in batches:
            cols = [[] for _ in range(5)]
            for t, p, r, v, f in zip(*(c.to_pylist() for c in b.columns)):
                points, held = np.array([(q["x"], q["y"]) for q in v]), np.zeros(len(v), bool)
                held[f or []] = True
                for lod, tolerance in tolerances.items():
                    got = simplify_ring(points, held, tolerance)
                    for c, x in zip(cols, (lod, t, p, r, [{"x": x, "y": y} for x, y in got.tolist()])):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), kind))], names=["lod", "territory", "part", "ring", "points"])

    rows = marked.select(F.col("territory").cast("string"), F.col("part").cast("int"), F.col("ring").cast("int"), "points", "f")
    return spread(rows).mapInArrow(run, "lod string, territory string, part int, ring int, points array<struct<x:double,y:double>>")


def simplify(rings: DataFrame, tolerance: float) -> DataFrame:
    """One level of thin_levels, without rings that are left with fewer than three vertices (levels.simplify_levels accounts for those)."""
    return thin_levels(rings, {"": tolerance}).drop("lod").where(F.size("points") >= 3)
