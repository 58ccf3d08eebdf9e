"""Ring algebra on arrays of struct(x, y); a geometry is an array of parts, a part an array of rings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
GEOMETRY = f"array<array<{RING}>>"


def once(value: Column, f) -> Column:
    """f(value), with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def storage(x: Column) -> Column:
    """A coordinate as the mesh stores it: rounded to 32 bits."""
    return x.cast("float").cast("double")


def quantize(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(storage(p["x"]).alias("x"), storage(p["y"]).alias("y")))


def next_of(ring: Column) -> Column:
    """Each vertex's successor, the first one after the last."""
    return once(ring, lambda r: F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, F.lit(1), F.lit(1))))


def signed_area(ring: Column) -> Column:
    """Shoelace; positive if counter-clockwise. A closing vertex adds nothing."""
    terms = once(ring, lambda r: F.zip_with(r, next_of(r), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]))
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) / 2


def open_ring(ring: Column) -> Column:
    """Without the closing vertex."""
    closed = lambda r: (F.size(r) > 1) & (F.try_element_at(r, F.lit(1)) == F.try_element_at(r, F.lit(-1)))
    return once(ring, lambda r: F.when(closed(r), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r))


def distinct_neighbours(ring: Column) -> Column:
    """Without vertices that equal their successor."""
    return F.filter(once(ring, lambda r: F.zip_with(r, next_of(r), lambda a, b: F.struct(a.alias("p"), (a == b).alias("same")))), lambda z: ~z["same"])


def prepare_ring(ring: Column, counter_clockwise: bool) -> Column:
    """Open, quantised, without repeats, wound as asked; null if fewer than 3 vertices or no area is left."""
    clean = F.transform(distinct_neighbours(quantize(open_ring(ring))), lambda z: z["p"])
    wound = lambda c: F.when((c["area"] > 0) == F.lit(counter_clockwise), c["ring"]).otherwise(F.reverse(c["ring"]))
    sized = once(clean, lambda r: F.struct(r.alias("ring"), signed_area(r).alias("area")))
    return once(sized, lambda c: F.when((F.size(c["ring"]) >= 3) & (c["area"] != 0), wound(c)))


def part_count(geometry: Column) -> Column:
    return F.size(geometry)


def hole_count(geometry: Column) -> Column:
    return F.aggregate(geometry, F.lit(0), lambda acc, part: acc + F.size(part) - 1)


def vertex_count(geometry: Column) -> Column:
    """All ring coordinates, closing vertices too."""
    return F.aggregate(geometry, F.lit(0), lambda acc, part: acc + F.aggregate(part, F.lit(0), lambda n, ring: n + F.size(ring)))


def polygon_area(part: Column) -> Column:
    """Exterior minus holes, whatever their winding."""
    areas = F.transform(part, lambda ring: F.abs(signed_area(ring)))
    return once(areas, lambda s: F.element_at(s, F.lit(1)) - F.aggregate(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.lit(0.0), lambda a, b: a + b))


def interior_area(geometry: Column) -> Column:
    """The area of all holes."""
    holes = F.flatten(F.transform(geometry, lambda part: F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0)))))
    return F.aggregate(F.transform(holes, lambda r: F.abs(signed_area(r))), F.lit(0.0), lambda a, b: a + b)


def drop_small(geometry: Column, floor: float) -> Column:
    """Parts whose exterior has more than `floor` area, with their holes of more than that."""
    big = F.filter(geometry, lambda part: F.abs(signed_area(F.element_at(part, 1))) > floor)
    return F.transform(big, lambda part: F.filter(part, lambda ring, i: (i == 0) | (F.abs(signed_area(ring)) > floor)))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The counter-clockwise ring of a rectangle."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))


def triangle_cross(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def in_triangle(px, py, ax, ay, bx, by, cx, cy) -> Column:
    """Inside or on an edge, for either winding: the point sees all three sides turn one way, or none."""
    turns = [triangle_cross(px, py, *side) for side in ((ax, ay, bx, by), (bx, by, cx, cy), (cx, cy, ax, ay))]
    return (F.least(*turns) >= 0) | (F.greatest(*turns) <= 0)
