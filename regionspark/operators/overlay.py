"""Planar overlay as joins: noding, repair, union, gaps, validity across rings.

Coordinates are whole numbers of a quantum (nine decimals of a degree by default),
so equal points are equal keys. Segments meet in grid cells of their own size
(`grid.level_join`), are cut where they cross or where an end of one lies on another,
and become noded edges: two of them share an end, all of their length or nothing.

* An edge used an even number of times bounds nothing under the even-odd rule; the
  others bound the surface of a crossing ring. That is `repair`: spikes and stray lines
  are used twice and vanish.
* An edge used in both directions lies inside a union, and so does one whose middle
  another member covers. The rest is its outline. That is `union`.
* Outlines are unordered. At each vertex a window by angle gives every edge its
  successor on the face to its left; `close_rings` follows successors within grid
  cells, then doubles pointers between the chains that remain.

`grp` names what is overlaid together (a territory, a pair, everything); groups never
meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._store import stored
from ..functions.rings import signed_area
from .grid import SMALL, level_join, stab_join

#: Degrees, or metres, that make one step of the coordinates.
QUANTUM = 1e-9
#: How far from a segment, in quanta, a vertex still lies on it.
NEAR = 0.5
#: Noding is repeated while rounded crossings make new ones, at most so often.
ROUNDS = 8

_ENDS = ("ax", "ay", "bx", "by")
_POINTS = "array<struct<x:double,y:double>>"


def _next(points: Column) -> Column:
    return F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def segments(rings: DataFrame, quantum: float = QUANTUM) -> DataFrame:
    """rings (grp, owner, part, ring, points; open or closed) -> grp, owner, part, ring, ax, ay, bx, by: a row per segment that has a length."""
    step = lambda c: F.round(c / quantum).cast("long")
    ends = F.arrays_zip(F.col("points").alias("a"), _next(F.col("points")).alias("b"))
    s = rings.select("grp", "owner", "part", "ring", F.explode(ends).alias("s"))
    s = s.select("grp", "owner", "part", "ring", *[step(F.col(f"s.{e}.{z}")).alias(f"{e}{z}") for e in "ab" for z in "xy"])
    return s.where("ax <> bx OR ay <> by")


def _boxed(s: DataFrame, margin: int = 1) -> DataFrame:
    low, high = (lambda a, b: F.least(a, b) - margin), (lambda a, b: F.greatest(a, b) + margin)
    return s.withColumns({"min_x": low("ax", "bx"), "max_x": high("ax", "bx"), "min_y": low("ay", "by"), "max_y": high("ay", "by")})


# The predicates below are SQL text: they are long, and a text is one call to the JVM.


def _d(a: str, b: str) -> str:
    return f"CAST({b} - {a} AS DOUBLE)"


def _cross(a: tuple, b: tuple, c: tuple) -> str:
    """Twice the signed area of the triangle a, b, c."""
    return f"({_d(a[0], b[0])} * {_d(a[1], c[1])} - {_d(a[1], b[1])} * {_d(a[0], c[0])})"


def _along(a: tuple, b: tuple, p: tuple) -> str:
    """How far p lies along a-b, times the length of a-b."""
    return f"({_d(a[0], b[0])} * {_d(a[0], p[0])} + {_d(a[1], b[1])} * {_d(a[1], p[1])})"


def _at(p: tuple, q: tuple) -> str:
    return f"({p[0]} = {q[0]} AND {p[1]} = {q[1]})"


def _on(p: tuple, a: tuple, b: tuple) -> str:
    """Whether p lies on the segment a-b, ends not included."""
    along, long = _along(a, b, p), _along(a, b, b)
    return f"(abs({_cross(a, b, p)}) <= {NEAR} * sqrt({long}) AND {along} > 0 AND {along} < {long} AND NOT {_at(p, a)} AND NOT {_at(p, b)})"


def _ends(side: str) -> tuple[tuple, tuple]:
    return (f"{side}_ax", f"{side}_ay"), (f"{side}_bx", f"{side}_by")


def _properly() -> str:
    """Whether two segments cross in a point inside both."""
    (a, b), (c, d) = _ends("l"), _ends("r")
    return f"(signum({_cross(a, b, c)}) * signum({_cross(a, b, d)}) < 0 AND signum({_cross(c, d, a)}) * signum({_cross(c, d, b)}) < 0)"


def _cut_points(s: DataFrame) -> DataFrame:
    """sid, x, y, moved: where segments (sid, grp, ends) are to be cut; moved if rounding shifted the point off one of them."""
    boxed = _boxed(s.select("sid", "grp", *_ENDS))
    pairs = level_join(boxed, boxed, ("grp",)).where("l_sid < r_sid")
    (a, b), (c, d) = _ends("l"), _ends("r")
    t = f"({_cross(c, d, a)} / nullif({_cross(c, d, a)} - {_cross(c, d, b)}, 0))"
    pairs = pairs.withColumn("proper", F.expr(_properly()))
    pairs = pairs.withColumns({f"e{z}": F.expr(f"CASE WHEN proper THEN {a[i]} + {t} * ({b[i]} - {a[i]}) END") for i, z in enumerate("xy")})
    pairs = pairs.withColumns({f"p{z}": F.expr(f"CAST(round(e{z}) AS BIGINT)") for z in "xy"})
    p = ("px", "py")
    cut = lambda when, side, at, moved: f"CASE WHEN {when} THEN named_struct('sid', {side}_sid, 'x', {at[0]}, 'y', {at[1]}, 'moved', {moved}) END"
    found = [cut(f"proper AND NOT {_at(p, _ends(side)[0])} AND NOT {_at(p, _ends(side)[1])}", side, p, "abs(ex - px) > 1e-6 OR abs(ey - py) > 1e-6") for side in "lr"]
    found += [cut(_on(v, a, b), "l", v, f"{_cross(a, b, v)} <> 0") for v in (c, d)]
    found += [cut(_on(v, c, d), "r", v, f"{_cross(c, d, v)} <> 0") for v in (a, b)]
    return pairs.select(F.expr(f"explode(array_compact(array({', '.join(found)})))").alias("c")).select("c.*")


def node(s: DataFrame) -> DataFrame:
    """The segments, cut so that those of a group meet in common ends only, or coincide.

    Cuts are rounded to whole quanta, which may move a piece across a
    neighbour; pieces are then noded again, until nothing has moved.
    """
    names = [c for c in s.columns if c not in _ENDS]
    s = stored(s.withColumn("sid", F.monotonically_increasing_id()), "segments")
    for _ in range(ROUNDS):
        cuts = stored(_cut_points(s).groupBy("sid").agg(F.collect_set(F.struct("x", "y")).alias("cuts"), F.max("moved").alias("moved")), "cuts")
        if cuts.isEmpty():
            break
        a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
        d = lambda u, v: (v - u).cast("double")
        far = lambda p: d(F.col("ax"), p["x"]) * d(F.col("ax"), F.col("bx")) + d(F.col("ay"), p["y"]) * d(F.col("ay"), F.col("by"))
        inner = F.transform(F.array_sort(F.transform("cuts", lambda p: F.struct(far(p).alias("t"), p["x"].alias("x"), p["y"].alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
        line = F.concat(F.array(a), F.coalesce(inner, F.array().cast("array<struct<x:bigint,y:bigint>>")), F.array(b))
        pieces = s.join(cuts.select("sid", "cuts"), "sid", "left").withColumn("line", line)
        pairs = F.arrays_zip(F.slice("line", F.lit(1), F.size("line") - 1).alias("a"), F.slice("line", F.lit(2), F.size("line") - 1).alias("b"))
        pieces = pieces.select(*names, F.explode(pairs).alias("p")).select(*names, *[F.col(f"p.{e}.{z}").alias(f"{e}{z}") for e in "ab" for z in "xy"])
        s = stored(pieces.where("ax <> bx OR ay <> by").withColumn("sid", F.monotonically_increasing_id()), "segments")
        if not cuts.where("moved").limit(1).count():
            break
    else:
        raise ValueError(f"segments still cross after {ROUNDS} rounds")
    return s.drop("sid")


def _undirected(s: DataFrame) -> DataFrame:
    """With lx, ly, hx, hy: the ends in order, the same for both directions; forward tells the direction."""
    forward = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    pick = lambda a, b: F.when(F.col("forward"), F.col(a)).otherwise(F.col(b))
    return s.withColumn("forward", forward).withColumns({"lx": pick("ax", "bx"), "ly": pick("ay", "by"), "hx": pick("bx", "ax"), "hy": pick("by", "ay")})


_LINE = ("lx", "ly", "hx", "hy")


def _turned(df: DataFrame, steep: Column) -> DataFrame:
    """u, v of both ends: (x, y) of steep edges, (y, x) of flat ones, so that a ray runs along u."""
    pick = lambda a, b: F.when(steep, F.col(a)).otherwise(F.col(b))
    return df.withColumns({"u0": pick("lx", "ly"), "v0": pick("ly", "lx"), "u1": pick("hx", "hy"), "v1": pick("hy", "hx")})


def below(probes: DataFrame, walls: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """eid, `by`, n: how many walls a ray from the middle of each probe edge meets on the side of smaller u.

    probes: eid, `by`, lx, ly, hx, hy; walls: `by` and the same ends. The ray runs
    towards smaller x from steep edges and towards smaller y from flat ones;
    the edge itself is no wall of its own. Edges must be noded.
    """
    steep = F.abs(F.col("hy") - F.col("ly")) >= F.abs(F.col("hx") - F.col("lx"))
    p = _turned(probes.withColumn("steep", steep), F.col("steep"))
    p = p.select("eid", *by, "steep", ((F.col("v0") + F.col("v1")) / 2).alias("at"), ((F.col("u0") + F.col("u1")) / 2).alias("u"), *_LINE)
    both = walls.select(*by, *_LINE).withColumn("steep", F.explode(F.array(F.lit(True), F.lit(False))))
    w = _turned(both, F.col("steep")).where("v0 <> v1")
    up = F.col("v0") < F.col("v1")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b)).cast("double")
    w = w.select(*by, "steep", pick("v0", "v1").alias("low"), pick("v1", "v0").alias("high"), pick("u0", "u1").alias("u_low"), pick("u1", "u0").alias("u_high"), *_LINE)
    met = stab_join(p, w, (*by, "steep"))
    u = F.col("w_u_low") + (F.col("p_at") - F.col("w_low")) * (F.col("w_u_high") - F.col("w_u_low")) / (F.col("w_high") - F.col("w_low"))
    same = (F.col("w_lx") == F.col("p_lx")) & (F.col("w_ly") == F.col("p_ly")) & (F.col("w_hx") == F.col("p_hx")) & (F.col("w_hy") == F.col("p_hy"))
    hits = met.where(~same & (u < F.col("p_u"))).groupBy(F.col("p_eid").alias("eid"), *by).agg(F.count(F.lit(1)).alias("n"))
    return probes.select("eid", *by).join(hits.hint("merge"), ["eid", *by], "left").select("eid", *by, F.coalesce("n", F.lit(0)).alias("n"))


def even_odd(noded: DataFrame) -> DataFrame:
    """grp, eid, ax, ay, bx, by: the edges that bound the even-odd surface of each group, the surface on their left."""
    lines = _undirected(noded).groupBy("grp", *_LINE).agg(F.count(F.lit(1)).alias("uses")).where("uses % 2 = 1").drop("uses")
    lines = stored(lines.withColumn("eid", F.monotonically_increasing_id()), "odd-edges")
    sides = below(lines, lines, ("grp",))
    steep = F.abs(F.col("hy") - F.col("ly")) >= F.abs(F.col("hx") - F.col("lx"))
    inside_small = F.col("n") % 2 == 1
    # left of an upward edge is smaller x, left of a rightward one larger y; l -> h goes rightward, or upward if vertical
    upward = F.col("hy") > F.col("ly")
    keep = F.when(steep, upward == inside_small).otherwise(~inside_small)
    pick = lambda a, b: F.when(keep, F.col(a)).otherwise(F.col(b))
    both = lines.join(sides.select("eid", "n"), "eid")
    return both.select("grp", "eid", pick("lx", "hx").alias("ax"), pick("ly", "hy").alias("ay"), pick("hx", "lx").alias("bx"), pick("hy", "ly").alias("by"))


def outline(noded: DataFrame) -> DataFrame:
    """grp, eid, ax, ay, bx, by: the border of the union of each group's owners, the union on the left.

    Owners are valid surfaces, exteriors counter-clockwise and holes clockwise.
    An edge used both ways has surface on both sides; one whose middle lies in
    another owner, too. A middle is held against owners whose box holds it only.
    """
    e = _undirected(noded)
    one = e.groupBy("grp", *_LINE).agg(F.bool_or("forward").alias("f"), F.bool_or(~F.col("forward")).alias("b"), F.collect_set("owner").alias("owners")).where("f <> b")
    one = stored(one.withColumn("eid", F.monotonically_increasing_id()), "outline-edges")
    walls = stored(e.groupBy("grp", "owner", *_LINE).agg(F.count(F.lit(1)).alias("uses")).where("uses % 2 = 1").drop("uses"), "outline-walls")
    boxes = walls.groupBy("grp", "owner").agg(F.min("lx").alias("min_x"), F.max("hx").alias("max_x"), F.least(F.min("ly"), F.min("hy")).alias("min_y"), F.greatest(F.max("ly"), F.max("hy")).alias("max_y"))
    mx, my = (F.col("lx") + F.col("hx")) / 2, (F.col("ly") + F.col("hy")) / 2
    middles = one.select("grp", "eid", "owners", *_LINE, mx.alias("min_x"), mx.alias("max_x"), my.alias("min_y"), my.alias("max_y"))
    near = level_join(middles, boxes.select("grp", "owner", *[F.col(c).cast("double").alias(c) for c in ("min_x", "max_x", "min_y", "max_y")]), ("grp",))
    near = near.where(~F.array_contains("l_owners", F.col("r_owner"))).select("grp", F.col("r_owner").alias("owner"), F.col("l_eid").alias("eid"), *[F.col(f"l_{c}").alias(c) for c in _LINE])
    covered = below(near, walls, ("grp", "owner")).where("n % 2 = 1").select("eid").distinct()
    pick = lambda a, b: F.when(F.col("f"), F.col(a)).otherwise(F.col(b))
    return one.join(covered, "eid", "left_anti").select("grp", "eid", pick("lx", "hx").alias("ax"), pick("ly", "hy").alias("ay"), pick("hx", "lx").alias("bx"), pick("hy", "ly").alias("by"))


def successors(edges: DataFrame) -> DataFrame:
    """edges (grp, eid, ends, surface on the left) with `next`: the edge that follows on the border of the face on the left.

    Around a vertex, going clockwise from where an edge comes from, the first
    edge met leads on; so faces that touch in a vertex stay apart.
    """
    angle = lambda x0, y0, x1, y1: F.atan2((F.col(y1) - F.col(y0)).cast("double"), (F.col(x1) - F.col(x0)).cast("double"))
    into = edges.select("grp", F.col("bx").alias("x"), F.col("by").alias("y"), angle("bx", "by", "ax", "ay").alias("turn"), F.lit(True).alias("comes"), "eid")
    out = edges.select("grp", F.col("ax").alias("x"), F.col("ay").alias("y"), angle("ax", "ay", "bx", "by").alias("turn"), F.lit(False).alias("comes"), "eid")
    around = Window.partitionBy("grp", "x", "y").orderBy(F.desc("turn"), "comes")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = into.unionByName(out)
    follows = F.coalesce(F.lead("eid").over(around), F.first("eid").over(whole))
    return edges.join(both.withColumn("next", follows).where("comes").select("eid", "next").hint("merge"), "eid")


def _chains(linked: DataFrame, cell: float) -> DataFrame:
    """grp, chain, next, points: edges joined to chains within cells; a closed one is its own next. A group of few edges is one cell."""
    few = linked.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= SMALL).select("grp", F.lit(True).alias("few"))
    at = lambda c: F.when(F.col("few"), F.lit(0)).otherwise(F.floor(F.col(c) / F.lit(cell)))
    rows = linked.join(few.hint("merge"), "grp", "left").select("grp", at("ax").alias("cx"), at("ay").alias("cy"), "eid", "next", "ax", "ay").repartition("grp", "cx", "cy").sortWithinPartitions("grp", "cx", "cy")
    kind = rows.schema["grp"].dataType.simpleString()

    def joined(rows: list[tuple]):
        of = {r[3]: r for r in rows}
        followed = {r[4] for r in rows}
        heads = [e for e in of if e not in followed] + sorted(of)
        for head in heads:
            if head not in of:
                continue
            e, xs, ys = head, [], []
            while e in of:
                r = of.pop(e)
                xs.append(r[5])
                ys.append(r[6])
                e = r[4]
            yield rows[0][0], head, e, xs, ys

    def run(batches):
        group, key = [], None
        names = ["grp", "chain", "next", "xs", "ys"]

        def batch(found, first):
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], first), *[pa.array([f[i] for f in found], pa.int64() if i < 3 else pa.list_(pa.int64())) for i in range(1, 5)]], names=names)

        for b in batches:
            found = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if group and r[:3] != key:
                    found += joined(group)
                    group = []
                key = r[:3]
                group.append(r)
            kind_of = b.schema.field(0).type
            yield batch(found, kind_of)
        if group:
            yield batch(list(joined(group)), kind_of)

    return rows.mapInArrow(run, f"grp {kind}, chain bigint, next bigint, xs array<bigint>, ys array<bigint>")


def _ranked(chains: DataFrame) -> DataFrame:
    """chain, ring, rank: the ring (its least chain) that each open chain is part of, and its place there, by pointer doubling."""
    hop = stored(chains.select("chain", F.col("next").alias("to"), F.least("chain", "next").alias("ring")), "ring-hops")
    while True:
        further = hop.select(F.col("chain").alias("to"), F.col("to").alias("to2"), F.col("ring").alias("ring2"))
        new = stored(hop.join(further, "to").select("chain", F.col("to2").alias("to"), F.least("ring", "ring2").alias("ring"), (F.col("ring2") < F.col("ring")).alias("fell")), "ring-hops")
        done = not new.where("fell").limit(1).count()
        hop = new.drop("fell")
        if done:
            break
    # from each chain, the number of hops to the last chain before the ring's least one
    ends = chains.join(hop.select("chain", "ring"), "chain")
    far = stored(ends.select("chain", "ring", F.when(F.col("next") == F.col("ring"), F.lit(None)).otherwise(F.col("next")).alias("to"), F.when(F.col("next") == F.col("ring"), 0).otherwise(1).cast("long").alias("n")), "ring-far")
    while far.where("`to` IS NOT NULL").limit(1).count():
        further = far.select(F.col("chain").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"))
        far = stored(far.join(further, "to", "left").select("chain", "ring", F.col("to2").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")), "ring-far")
    return far.select("chain", "ring", (-F.col("n")).alias("rank"))


def _simple_cycles(xs: list[int], ys: list[int]) -> list[list[tuple[int, int]]]:
    """A closed walk cut into cycles that visit no vertex twice, without vertices in the middle of straight lines."""
    stack, place, out = [], {}, []
    for p in zip(xs, ys):
        if p in place:
            at = place[p]
            out.append(stack[at:])
            for q in stack[at:]:
                del place[q]
            del stack[at:]
        place[p] = len(stack)
        stack.append(p)
    out.append(stack)
    kept = []
    for c in out:
        n = len(c)
        bent = [c[i] for i in range(n) if (c[i][0] - c[i - 1][0]) * (c[(i + 1) % n][1] - c[i][1]) != (c[i][1] - c[i - 1][1]) * (c[(i + 1) % n][0] - c[i][0])]
        if len(bent) > 2:
            k = bent.index(min(bent))
            kept.append(bent[k:] + bent[:k])
    return kept


def close_rings(edges: DataFrame, quantum: float = QUANTUM) -> DataFrame:
    """grp, ring, points, area: the closed rings of unordered border edges (grp, eid, ends, surface on the left).

    Exteriors have positive areas, holes negative ones; rings are open, begin at
    their least vertex and hold no vertex twice. ring numbers are unique.
    """
    linked = stored(successors(edges), "linked")
    side = linked.agg(F.expr("approx_percentile(greatest(abs(bx - ax), abs(by - ay)), 0.5)")).first()[0]
    chains = stored(_chains(linked, 64.0 * (side or 1)), "chains")
    whole = chains.where("chain = next").select("grp", "xs", "ys")
    if chains.where("chain <> next").limit(1).count():
        parts = chains.where("chain <> next")
        parts = parts.join(_ranked(parts.select("chain", "next")), "chain").groupBy("grp", "ring").agg(F.array_sort(F.collect_list(F.struct("rank", "xs", "ys"))).alias("c"))
        whole = whole.unionByName(parts.select("grp", F.flatten("c.xs").alias("xs"), F.flatten("c.ys").alias("ys")))
    kind = whole.schema["grp"].dataType.simpleString()

    def run(batches):
        for b in batches:
            cycles = [_simple_cycles(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            of = np.repeat(np.arange(len(cycles)), [len(c) for c in cycles])
            points = [[{"x": x * quantum if quantum >= 1 else x / round(1 / quantum), "y": y * quantum if quantum >= 1 else y / round(1 / quantum)} for x, y in c] for cs in cycles for c in cs]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(points, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))], names=["grp", "points"])

    rings = whole.select("grp", "xs", "ys").mapInArrow(run, f"grp {kind}, points {_POINTS}")
    return stored(rings.select("grp", F.monotonically_increasing_id().alias("ring"), "points", signed_area(F.col("points")).alias("area")), "rings")


def assemble(rings: DataFrame, quantum: float = QUANTUM) -> DataFrame:
    """grp, shell, rings (the exterior first), area: each exterior of close_rings with the holes that lie in it and in no smaller one."""
    shells = rings.where("area > 0").select("grp", F.col("ring").alias("shell"), "points", "area")
    holes = rings.where("area < 0").select("grp", F.col("ring").alias("hole"), "points", "area")
    inside = _inside(holes.select("grp", F.col("hole").alias("id"), "points"), shells.select("grp", F.col("shell").alias("id"), "points"), quantum)
    sized = inside.join(shells.select(F.col("shell").alias("outer"), F.col("area").alias("outer_area")), "outer")
    owner = sized.groupBy(F.col("inner").alias("hole")).agg(F.min_by("outer", F.struct("outer_area", "outer")).alias("shell"))
    own = holes.join(owner, "hole").groupBy("shell").agg(F.array_sort(F.collect_list("points")).alias("holes"), F.sum("area").alias("hole_area"))
    none = F.array().cast(f"array<{_POINTS}>")
    return shells.join(own, "shell", "left").select("grp", "shell", F.concat(F.array("points"), F.coalesce("holes", none)).alias("rings"), (F.col("area") + F.coalesce("hole_area", F.lit(0.0))).alias("area"))


def _lines(rings: DataFrame, quantum: float, *names: str) -> DataFrame:
    """names and the ordered ends of all segments of rings (points)."""
    s = segments(rings.select(*names, F.lit(0).alias("part"), "points").select(F.struct(*names).alias("grp"), F.lit("").alias("owner"), "part", F.lit(0).alias("ring"), "points"), quantum)
    return _undirected(s).select(*[F.col(f"grp.{n}").alias(n) for n in names], *_LINE)


def _inside(inner: DataFrame, outer: DataFrame, quantum: float) -> DataFrame:
    """grp, inner, outer: rings (grp, id, points) of `inner` whose first edge's middle lies in a ring of `outer` of the same group."""
    first = inner.withColumn("points", F.slice("points", 1, 2))
    probes = _lines(first, quantum, "grp", "id").dropDuplicates(["grp", "id"]).withColumnRenamed("id", "inner")
    walls = _lines(outer, quantum, "grp", "id").withColumnRenamed("id", "outer")
    boxes = walls.groupBy("grp", "outer").agg(F.min("lx").alias("min_x"), F.max("hx").alias("max_x"), F.least(F.min("ly"), F.min("hy")).alias("min_y"), F.greatest(F.max("ly"), F.max("hy")).alias("max_y"))
    mx, my = (F.col("lx") + F.col("hx")) / 2, (F.col("ly") + F.col("hy")) / 2
    near = level_join(
        probes.select("grp", "inner", *_LINE, mx.alias("min_x"), mx.alias("max_x"), my.alias("min_y"), my.alias("max_y")),
        boxes.select("grp", "outer", *[F.col(c).cast("double").alias(c) for c in ("min_x", "max_x", "min_y", "max_y")]),
        ("grp",),
    )
    near = near.select("grp", F.col("r_outer").alias("outer"), F.col("l_inner").alias("eid"), *[F.col(f"l_{c}").alias(c) for c in _LINE])
    return below(near, walls, ("grp", "outer")).where("n % 2 = 1").select("grp", F.col("eid").alias("inner"), "outer")


def _once(rings: DataFrame) -> DataFrame:
    """rings (grp, points) without repeats of a cycle within a ring and without rings that hold the same edges again."""
    p = F.filter(F.zip_with("points", _next(F.col("points")), lambda a, b: F.struct(a.alias("p"), (a == b).alias("same"))), lambda z: ~z["same"])
    r = rings.withColumn("points", F.transform(p, lambda z: z["p"]))
    n = F.size("points")
    again = lambda k: (n % k == 0) & (F.slice("points", k + 1, n - k) == F.slice("points", F.lit(1), n - k))
    cycle = F.try_element_at(F.filter(F.when(n > 1, F.sequence(F.lit(1), F.floor(n / 2).cast("int"))).otherwise(F.array().cast("array<int>")), again), F.lit(1))
    r = r.withColumn("points", F.slice("points", F.lit(1), F.coalesce(cycle, n)))
    edges = F.array_sort(F.zip_with("points", _next(F.col("points")), lambda a, b: F.struct(F.least(a, b).alias("l"), F.greatest(a, b).alias("h"))))
    return r.withColumn("__edges", edges).dropDuplicates(["grp", "__edges"]).drop("__edges")


def surfaces(rings: DataFrame, quantum: float = QUANTUM) -> DataFrame:
    """grp, shell, rings, area: the even-odd surface of each group's rings (grp, points), however they cross.

    Every part is a valid polygon, exterior counter-clockwise; spikes, lines and
    points are gone. A ring that runs through one cycle several times counts
    once, and so do equal rings. Null points and rings of no area leave nothing.
    """
    clean = rings.select("grp", F.filter(F.coalesce("points", F.array().cast(_POINTS)), lambda p: p.isNotNull()).alias("points"))
    named = _once(clean).select("grp", F.lit("").alias("owner"), F.lit(0).alias("part"), F.lit(0).alias("ring"), "points")
    return assemble(close_rings(even_odd(node(segments(named, quantum))), quantum), quantum)


def union(rings: DataFrame, quantum: float = QUANTUM) -> DataFrame:
    """grp, shell, rings, area: the union of each group's owners (grp, owner, points; valid surfaces), part by part."""
    area = signed_area(F.col("points"))
    # wound by what they are: exteriors (ring 0) counter-clockwise, holes clockwise
    wound = F.when((area > 0) == (F.col("ring") == 0), F.col("points")).otherwise(F.reverse("points"))
    s = segments(rings.select("grp", "owner", "part", "ring", wound.alias("points")), quantum)
    return assemble(close_rings(outline(node(s)), quantum), quantum)


def hole_area(parts: DataFrame) -> DataFrame:
    """grp, hole_area of surfaces (grp, rings)."""
    holes = F.aggregate(F.transform(F.slice("rings", 2, F.size("rings")), lambda r: F.abs(signed_area(r))), F.lit(0.0), lambda a, b: a + b)
    return parts.groupBy("grp").agg(F.sum(holes).alias("hole_area"))


def pair_gaps(rings: DataFrame, pairs: DataFrame, quantum: float = QUANTUM) -> DataFrame:
    """left, right, gap: the area that the union of two territories encloses without covering it, beyond the territories' own holes.

    rings: territory, part, ring, points; pairs: left, right. Each pair is a
    group of its own, so a territory is overlaid once a neighbour.
    """
    grp = F.struct("left", "right")
    both = pairs.select(grp.alias("grp"), F.explode(F.array("left", "right")).alias("territory")).distinct()
    members = both.join(rings, "territory").select("grp", F.col("territory").alias("owner"), "part", "ring", "points")
    held = hole_area(union(members, quantum))
    own = rings.where("ring > 0").groupBy("territory").agg(F.sum(F.abs(signed_area(F.col("points")))).alias("own"))
    known = both.join(own, "territory").groupBy("grp").agg(F.sum("own").alias("own"))
    found = pairs.select(grp.alias("grp")).distinct().join(held, "grp", "left").join(known, "grp", "left")
    gap = F.greatest(F.coalesce("hole_area", F.lit(0.0)) - F.coalesce("own", F.lit(0.0)), F.lit(0.0))
    return found.select("grp.left", "grp.right", gap.alias("gap"))


def noded_rings(rings: DataFrame, quantum: float = QUANTUM) -> DataFrame:
    """territory, part, ring, ax, ay, bx, by, edge of rings (territory, part, ring, points), cut at all vertices that lie on them.

    With borders cut at T-junctions, equal edges say who shares a border
    (edges.neighbours), whatever the sizes of the cells on both sides.
    """
    s = node(segments(rings.select(F.lit(0).alias("grp"), F.col("territory").alias("owner"), "part", "ring", "points"), quantum))
    line = _undirected(s)
    scale = (lambda c: F.col(c) * quantum) if quantum >= 1 else (lambda c: F.col(c) / round(1 / quantum))
    return line.select(F.col("owner").alias("territory"), "part", "ring", *[scale(c).alias(c) for c in _ENDS], F.struct(*_LINE).alias("edge"))


def ring_faults(rings: DataFrame, quantum: float = QUANTUM) -> DataFrame:
    """territory, part, ring, fault: what makes rings (territory, part, ring, points) invalid together.

    self_crossing: a ring crosses, overlaps or touches itself. rings_cross: a
    ring crosses another of the territory or runs along it. Of rings that don't:
    hole_outside: a hole lies outside its exterior; nested_holes: a hole lies in
    another of its part; parts_overlap: an exterior lies in the surface of another part.
    A hole that touches its exterior in a point is sound. Rows name the inner ring, or the
    one of larger part and ring; a fault is named once a ring.
    """
    open_points = F.when((F.size("points") > 1) & (F.try_element_at("points", F.lit(1)) == F.try_element_at("points", F.lit(-1))), F.slice("points", F.lit(1), F.size("points") - 1)).otherwise(F.col("points"))
    rings = stored(rings.select("territory", "part", "ring", open_points.alias("points")), "fault-rings")
    step = lambda c: F.round(c / quantum).cast("long")
    s = rings.select("territory", "part", "ring", F.size("points").alias("size"), F.posexplode(F.arrays_zip(F.col("points").alias("a"), _next(F.col("points")).alias("b"))).alias("seq", "s"))
    s = s.select(F.col("territory").alias("grp"), "part", "ring", "size", "seq", *[step(F.col(f"s.{e}.{z}")).alias(f"{e}{z}") for e in "ab" for z in "xy"]).where("ax <> bx OR ay <> by")
    boxed = _boxed(s, 0)
    pairs = level_join(boxed, boxed, ("grp",)).where("(l_part, l_ring, l_seq) < (r_part, r_ring, r_seq)")
    (a, b), (c, d) = _ends("l"), _ends("r")
    same_ring, follows, closes = "(l_part = r_part AND l_ring = r_ring)", "(r_seq - l_seq = 1)", "(r_seq - l_seq = l_size - 1)"
    overlap = f"({_cross(a, b, c)} = 0 AND {_cross(a, b, d)} = 0 AND least(greatest({_along(a, b, c)}, {_along(a, b, d)}), {_along(a, b, b)}) > greatest(least({_along(a, b, c)}, {_along(a, b, d)}), 0))"
    on = f"({_on(c, a, b)} OR {_on(d, a, b)} OR {_on(a, c, d)} OR {_on(b, c, d)})"
    ends = {"ac": _at(a, c), "ad": _at(a, d), "bc": _at(b, c), "bd": _at(b, d)}
    of = lambda *names: " OR ".join(ends[n] for n in names)
    # edges that follow each other share one end; whatever else they share is a touch
    meet = f"CASE WHEN {follows} AND {closes} THEN false WHEN {follows} THEN {of('ac', 'ad', 'bd')} WHEN {closes} THEN {of('ac', 'bc', 'bd')} ELSE {of(*ends)} END"
    crossed_or_over = f"({_properly()} OR {overlap})"
    fault = F.expr(f"CASE WHEN {same_ring} AND ({crossed_or_over} OR {on} OR {meet}) THEN 'self_crossing' WHEN NOT {same_ring} AND {crossed_or_over} THEN 'rings_cross' END")
    crossing = stored(pairs.select(F.col("grp").alias("territory"), F.col("r_part").alias("part"), F.col("r_ring").alias("ring"), fault.alias("fault"), F.col("l_part").alias("o_part"), F.col("l_ring").alias("o_ring")).where("fault IS NOT NULL").distinct(), "crossing-rings")
    crossed = crossing.select("territory", "part", "ring").unionByName(crossing.select("territory", F.col("o_part").alias("part"), F.col("o_ring").alias("ring"))).distinct()
    sound = stored(rings.join(crossed, ["territory", "part", "ring"], "left_anti").select("territory", F.struct("part", "ring").alias("id"), "points"), "sound-rings")
    grouped = sound.select(F.col("territory").alias("grp"), "id", "points")
    # of a part whose exterior crosses something nothing is known about inside and outside
    holes = grouped.where("id.ring > 0")
    inside = stored(_inside(grouped, grouped, quantum).where("inner <> outer"), "inside")
    in_own = inside.where("inner.part = outer.part AND inner.ring > 0 AND outer.ring = 0").select("grp", F.col("inner").alias("id"))
    shells = grouped.where("id.ring = 0").select("grp", F.col("id.part").alias("part"))
    placed = holes.join(shells, (holes["grp"] == shells["grp"]) & (F.col("id.part") == shells["part"]), "left_semi")
    outside = placed.join(in_own, ["grp", "id"], "left_anti").select("grp", "id", F.lit("hole_outside").alias("fault"))
    nested = inside.where("inner.part = outer.part AND inner.ring > 0 AND outer.ring > 0").select("grp", F.col("inner").alias("id"), F.lit("nested_holes").alias("fault"))
    # in another part's exterior, but not in one of that part's holes
    shell_in = inside.where("inner.ring = 0 AND inner.part <> outer.part").groupBy("grp", "inner", "outer.part").agg(F.max(F.col("outer.ring") == 0).alias("in_shell"), F.max(F.col("outer.ring") > 0).alias("in_hole"))
    over = shell_in.where("in_shell AND NOT in_hole").select("grp", F.col("inner").alias("id"), F.lit("parts_overlap").alias("fault"))
    placed_faults = outside.unionByName(nested).unionByName(over).select(F.col("grp").alias("territory"), "id.part", "id.ring", "fault")
    return crossing.select("territory", "part", "ring", "fault").unionByName(placed_faults).distinct()
