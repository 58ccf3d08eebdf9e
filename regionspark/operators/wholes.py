"""Levels of small territories, each in one piece: thinning, holes, events and account without a join.

A row is a territory. What `levels` reads off joins for rings of any number is read
off arrays here, by the same rules. Equal shapes are worked out once a task, wherever
they lie, if moving them loses no digit. A territory whose thinned rings are not
clearly sound is left to the joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import account, mesh

#: A territory of at most so many vertices is a row.
SMALL = 512
#: Rows that leave a task together.
ROWS = 2048
#: Distances of so many quanta and more are clear.
CLEAR = 4
#: Pairs of triangles that are clipped at once.
CLIPPED = 1 << 15

COUNTS = ("source_parts", "source_holes", "parts", "holes", "dropped", "merges", "splits", "created", "dropped_holes", "hole_merges", "hole_splits")
AREAS = ("source_area", "output_area", "removed_area", "added_area", "measured_removed", "measured_added")
#: Event kinds and the counts of an account that they make up.
_COUNTED = {"dropped_part": "dropped", "part_merge": "merges", "part_split": "splits", "part_created": "created", "dropped_hole": "dropped_holes", "hole_merge": "hole_merges", "hole_split": "hole_splits"}
REMOVED, ADDED = ("dropped_part", "boundary_retreat", "part_split"), ("dropped_hole", "boundary_advance", "part_merge", "part_created")

_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_RING = pa.struct([("part", pa.int32()), ("ring", pa.int32()), ("points", _POINTS)])
_EVENT = pa.struct([("kind", pa.string()), ("count", pa.int64()), ("area", pa.float64())])
_ACCOUNT = pa.struct([*[(c, pa.int64()) for c in COUNTS], *[(c, pa.float64()) for c in AREAS]])
SCHEMA = pa.schema([("lod", pa.string()), ("territory", pa.string()), ("sound", pa.bool_()), ("rings", pa.list_(_RING)), ("events", pa.list_(_EVENT)), ("account", _ACCOUNT)])
WHOLE = (
    "lod string, territory string, sound boolean, rings array<struct<part:int,ring:int,points:array<struct<x:double,y:double>>>>, events array<struct<kind:string,count:bigint,area:double>>, "
    f"account struct<{','.join([f'{c}:bigint' for c in COUNTS] + [f'{c}:double' for c in AREAS])}>"
)


def _signed(p: np.ndarray) -> float:
    q = np.concatenate([p[1:], p[:1]])
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2


def _in_ring(p: np.ndarray, ring: np.ndarray) -> bool:
    """Whether a point that lies on no edge is inside, by the even-odd rule."""
    a, b = ring, np.concatenate([ring[1:], ring[:1]])
    over = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    a, b = a[over], b[over]
    return bool((a[:, 0] + (p[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]) > p[0]).sum() % 2)


def clearly_sound(rings: list[tuple[int, int, np.ndarray]], quantum: float) -> bool:
    """Whether rings (part, ring, points) have none of the faults of overlay.ring_faults, and no two edges but neighbours come near each other.

    Where it is too close to call the answer is no.
    """
    if len({r[:2] for r in rings}) < len(rings):
        return False
    if not rings:
        return True
    size = np.array([len(p) for _, _, p in rings])
    a = np.concatenate([p for _, _, p in rings])
    base = a.min(axis=0)
    wide = float(np.abs(a).max())
    a = a - base
    start = np.cumsum(size) - size
    at = np.arange(len(a))
    after = at + 1
    after[start + size - 1] = start
    b = a[after]
    d = b - a
    long = np.sqrt((d * d).sum(axis=1))
    near = CLEAR * quantum + 1e-15 * wide
    slack = 1e-14 * float(a.max()) ** 2
    if (long <= near).any():
        return False
    low, high = np.minimum(a, b) - near, np.maximum(a, b) + near
    i, j = np.nonzero(np.triu((low[:, None] <= high[None]).all(axis=2) & (high[:, None] >= low[None]).all(axis=2), 1))
    turned = (after[j] == i) & (after[i] != j)
    i, j = np.where(turned, j, i), np.where(turned, i, j)
    cross = lambda e, p: d[e, 0] * (p[:, 1] - a[e, 1]) - d[e, 1] * (p[:, 0] - a[e, 0])
    sides = lambda e, f: (cross(e, a[f]), cross(e, b[f]), near * long[e] + slack)
    follows = after[i] == j
    (ua, ub, u), (va, vb, v) = sides(i, j), sides(j, i)
    bent = (np.abs(ub) > u) & (np.abs(va) > v) | ((d[i] * d[j]).sum(axis=1) > 0)
    apart = (np.minimum(ua, ub) > u) | (np.maximum(ua, ub) < -u) | (np.minimum(va, vb) > v) | (np.maximum(va, vb) < -v)
    if not np.where(follows, bent, apart).all():
        return False
    shell = {p: k for k, (p, r, _) in enumerate(rings) if r == 0}
    holes: dict[int, list[int]] = {}
    for k, (p, r, _) in enumerate(rings):
        if r > 0:
            holes.setdefault(p, []).append(k)
    inside = lambda k, m: _in_ring(rings[k][2][0], rings[m][2])
    for p, ks in holes.items():
        if p not in shell or any(not inside(k, shell[p]) or any(k != m and inside(k, m) for m in ks) for k in ks):
            return False
    return not any(p != q and inside(k, m) and not any(inside(k, h) for h in holes.get(q, ())) for p, k in shell.items() for q, m in shell.items())


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The areas that surfaces share, each given by its triangles (n, 3, 2)."""
    out = np.zeros(len(left) * len(right))
    if not out.size:
        return out.reshape(len(left), len(right))
    t, u = np.concatenate(left), np.concatenate(right)
    i, j = np.nonzero((t.min(axis=1)[:, None] <= u.max(axis=1)[None]).all(axis=2) & (t.max(axis=1)[:, None] >= u.min(axis=1)[None]).all(axis=2))
    of_t, of_u = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right))
    for k in range(0, len(i), CLIPPED):
        at = slice(k, k + CLIPPED)
        out += np.bincount(of_t[i[at]] * len(right) + of_u[j[at]], mesh.clip_areas(t[i[at]], u[j[at]]), len(out))
    return out.reshape(len(left), len(right))


def _parts(rings: list[tuple[int, int, np.ndarray]]) -> list[list[np.ndarray]]:
    of: dict[int, list[np.ndarray]] = {}
    for p, _, points in sorted(rings, key=lambda r: r[:2]):
        of.setdefault(p, []).append(points)
    return [of[p] for p in sorted(of)]


def accounted(source: list[tuple[int, int, np.ndarray]], output: list[tuple[int, int, np.ndarray]], triangles) -> tuple[np.ndarray, list[tuple[str, int, float]], dict[str, float]]:
    """(which output rings stay, events as kind, count and area, account) of a territory's rings (part, ring, points); triangles: those of a part's rings.

    The rules are those of levels.resolve_holes, account.account_events and account.hole_events.
    """
    share = account.CORRESPONDENCE
    s, o = ([k for k, r in enumerate(rings) if r[1] > 0] for rings in (source, output))
    sa, oa = (np.array([abs(_signed(rings[k][2])) for k in ks]) for rings, ks in ((source, s), (output, o)))
    shared = _overlaps([triangles([source[k][2]]) for k in s], [triangles([output[k][2]]) for k in o])
    least = np.minimum.outer(sa, oa)
    partner = (shared > 0) & (shared >= share * least)
    meets = partner & (least > 0)
    stays = np.ones(len(output), bool)
    stays[[k for k, held in zip(o, partner.any(axis=0)) if not held]] = False
    dropped = [source[k][2] for k, held in zip(s, partner.any(axis=1)) if not held]
    lost, made = ~meets.any(axis=1), ~meets.any(axis=0)
    by_i, by_j = meets.sum(axis=1), meets.sum(axis=0)
    holes = [("dropped_hole", int(lost.sum()), float(sa[lost].sum())), ("artifact_hole_removed", int(made.sum()), float(oa[made].sum()))]
    holes += [("hole_merge", int((by_j[by_j > 1] - 1).sum()), 0.0), ("hole_split", int((by_i[by_i > 1] - 1).sum()), 0.0)]

    output = [r for r, held in zip(output, stays) if held]
    src, out = _parts(source), _parts(output)
    area = lambda rings: abs(_signed(rings[0])) - sum(abs(_signed(r)) for r in rings[1:])
    sa, oa = (np.array([area(rings) for rings in parts]) for parts in (src, out))
    cut = [triangles(rings) for rings in out]
    shared = _overlaps([triangles(rings) for rings in src], cut)
    fill = _overlaps([triangles([p]) for p in dropped], cut)
    covered = shared.sum(axis=1)
    gone = (sa > 0) & (covered < share * sa)
    least = np.minimum.outer(sa, oa)
    meets = ~gone[:, None] & (least > 0) & (shared > 0) & (shared >= share * least)
    by_i, by_j = meets.sum(axis=1), meets.sum(axis=0)
    lost = gone | (by_i == 0)
    left = np.maximum(sa - covered, 0.0)
    new = np.maximum(oa - shared.sum(axis=0) - fill.sum(axis=0), 0.0)
    noise = float(sa.sum()) * account.RELATIVE_SLACK
    named = lambda kind, which, times, areas: (kind, int(times[which].sum()), float(areas[which].sum()))
    one = np.ones(len(src), np.int64)
    events = [named("dropped_part", lost, one, left), named("part_split", ~lost & (by_i > 1), by_i - 1, left)]
    events += [("severe_shrink", int((~lost & (sa > 0) & (covered < account.SEVERE * sa)).sum()), 0.0)]
    one = np.ones(len(out), np.int64)
    events += [named("part_created", by_j == 0, one, new), named("part_merge", by_j > 1, by_j - 1, new)]
    events = [e for e in events if e[1]]
    for kind, far in (("boundary_retreat", left[~lost & (by_i == 1)].sum()), ("boundary_advance", new[by_j == 1].sum())):
        if far > noise:
            events.append((kind, 1, float(far)))
    # a dropped hole's area is what of it the territory covers now
    events += [(kind, n, float(fill.sum()) if kind == "dropped_hole" else a) for kind, n, a in holes if n]

    total: dict[str, float] = {c: 0 for c in COUNTS} | {c: 0.0 for c in AREAS}
    for rings, name in ((source, "source_"), (output, "")):
        total[f"{name}parts"], total[f"{name}holes"] = sum(r[1] == 0 for r in rings), sum(r[1] > 0 for r in rings)
    total["source_area"], total["output_area"], both = float(sa.sum()), float(oa.sum()), float(shared.sum())
    total["measured_removed"], total["measured_added"] = max(total["source_area"] - both, 0.0), max(total["output_area"] - both, 0.0)
    for kind, n, a in events:
        if kind in _COUNTED:
            total[_COUNTED[kind]] += n
        if kind in REMOVED or kind in ADDED:
            total["removed_area" if kind in REMOVED else "added_area"] += a
    return stays, events, total


def _levels_of(rings: list[tuple[int, int, np.ndarray]], fixed: list[np.ndarray], tolerances: list[float], quantum: float) -> list[tuple]:
    """For each level: whether it is sound, vertices' numbers in the territory, sizes, parts and numbers of its rings, events, account."""
    known: dict[tuple, np.ndarray] = {}

    def triangles(part: list[np.ndarray]) -> np.ndarray:
        key = tuple(r.tobytes() for r in part)
        if key not in known:
            kept, t, _ = mesh._built(part)
            known[key] = np.concatenate(kept)[t] if len(t) else np.zeros((0, 3, 2))
        return known[key]

    size = np.array([len(p) for _, _, p in rings])
    start = np.cumsum(size) - size
    made = []
    for tolerance in tolerances:
        at = [mesh.kept_of_ring(p, held, tolerance) if len(p) else np.zeros(0, np.int64) for (_, _, p), held in zip(rings, fixed)]
        thin = [(p, r, points[k]) for (p, r, points), k in zip(rings, at)]
        alive = [len(p) >= 3 and _signed(p) != 0 for _, _, p in thin]
        shells = {thin[k][0] for k in range(len(thin)) if alive[k] and thin[k][1] == 0}
        which = np.array([k for k in range(len(thin)) if alive[k] and thin[k][0] in shells], np.int64)
        output = [thin[k] for k in which]
        sound = clearly_sound(output, quantum)
        stays, events, total = accounted(rings, output, triangles) if sound else (np.ones(len(output), bool), [], None)
        which = which[stays]
        idx = np.concatenate([start[k] + at[k] for k in which]) if len(which) else np.zeros(0, np.int64)
        ids = [(len(at[k]), *rings[k][:2]) for k in which]
        made.append((sound, idx, np.array(ids, np.int64).reshape(-1, 3), events, total))
    return made


def _moved(xy: np.ndarray, origin: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
    """Vertices relative to their territory's origin where no digit is lost, and as they are in all other territories."""
    d = xy - origin[of]
    back = d - xy
    whole = ((xy - (d - back)) + (-origin[of] - back) == 0) & (xy.astype(np.float32) == xy) & (d.astype(np.float32) == d)
    lost = np.bincount(of, ~whole.all(axis=1), count)
    return np.where((lost == 0)[of][:, None], d, xy)


def whole_levels(batches: Iterator[pa.RecordBatch], tolerances: dict[str, float], quantum: float) -> Iterator[pa.RecordBatch]:
    """territory, r (its rings by part and ring), f (its fixed vertices as part, ring, seq, or null) -> rows of SCHEMA, one a level."""
    known: dict[tuple, list[tuple]] = {}
    held = 0
    for b in batches:
        names, col, marks = b.column(0).to_pylist(), b.column(1), b.column(2)
        ends = col.offsets.to_numpy()
        part, number, lists = (col.values.field(k) for k in range(3))
        part, number = part.to_numpy(), number.to_numpy()
        inner = lists.offsets.to_numpy()
        xy = np.stack([lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(2)], axis=1) + 0.0
        first = inner[ends]
        ring_of = np.repeat(np.arange(len(names)), np.diff(ends))
        of = np.repeat(np.arange(len(names)), np.diff(first))
        fixed = np.zeros(len(xy), bool)
        if len(marks.values):
            at = np.repeat(np.arange(len(names)), np.diff(marks.offsets.to_numpy()))
            p, r, seq = (marks.values.field(k).to_numpy() for k in range(3))
            both = np.concatenate([np.stack([ring_of, part, number], axis=1), np.stack([at, p, r], axis=1)])
            _, where, code = np.unique(both, axis=0, return_index=True, return_inverse=True)
            fixed[inner[where[code.reshape(-1)[len(ring_of) :]]] + seq] = True
        rel = _moved(xy, xy[np.minimum(first[:-1], max(len(xy) - 1, 0))], of, len(names)) if len(xy) else xy
        ids = np.stack([part, number, np.diff(inner)], axis=1)
        for x in range(0, len(names), ROWS):
            rows = range(x, min(x + ROWS, len(names)))
            found = []
            for k in rows:
                lo, hi = ends[k], ends[k + 1]
                v, w = first[k], first[k + 1]
                key = (ids[lo:hi].tobytes(), rel[v:w].tobytes(), fixed[v:w].tobytes())
                if key not in known:
                    held += w - v
                    if len(known) >= 4096 or held > 1 << 16:  # what is kept is a few dozen MB at most
                        known.clear()
                        held = w - v
                    rings = [(int(part[m]), int(number[m]), rel[inner[m] : inner[m + 1]]) for m in range(lo, hi)]
                    known[key] = _levels_of(rings, [fixed[inner[m] : inner[m + 1]] for m in range(lo, hi)], list(tolerances.values()), quantum)
                found.append(known[key])
            flat = [level for levels in found for level in levels]
            base = np.repeat(first[list(rows)], len(tolerances))
            sizes = np.array([len(level[1]) for level in flat])
            points = xy[np.concatenate([level[1] for level in flat]) + np.repeat(base, sizes)]
            of_ring = np.concatenate([level[2] for level in flat])
            pts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, z])) for z in range(2)], ["x", "y"])
            each = pa.StructArray.from_arrays([pa.array(of_ring[:, 1], pa.int32()), pa.array(of_ring[:, 2], pa.int32()), _listed(of_ring[:, 0], pts)], ["part", "ring", "points"])
            events = [e for level in flat for e in level[3]]
            said = pa.StructArray.from_arrays([pa.array([e[c] for e in events], t.type) for c, t in enumerate(_EVENT)], ["kind", "count", "area"])
            cols = [
                pa.array(list(tolerances) * len(rows), pa.string()),
                pa.array([names[k] for k in rows for _ in tolerances], pa.string()),
                pa.array([level[0] for level in flat], pa.bool_()),
                _listed([len(level[2]) for level in flat], each),
                _listed([len(level[3]) for level in flat], said),
                pa.array([level[4] for level in flat], _ACCOUNT),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, SCHEMA)], schema=SCHEMA)


def _listed(sizes, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)
