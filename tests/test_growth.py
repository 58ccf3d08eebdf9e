"""What keeps work in proportion to the input: rows dealt over tasks, no broadcast by size on disk, equal things once, grids for large groups only."""

import itertools
import random

import numpy as np
import pytest
from conftest import DATA

from regionspark.operators import edges, grid, mesh, overlay
from regionspark.plans import queries

BOX = "g int, id int, min_x double, min_y double, max_x double, max_y double"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _ring(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_rings_are_dealt_over_tasks(spark):
    """one small file was one task, however long each of its rings took."""
    assert "RoundRobinPartitioning" in _plan(queries.QUERIES["prepared_rings"](spark, f"{DATA}/sf0.001"))


def test_parts_are_dealt_over_tasks(spark):
    """triangulation ran where its rows happened to lie; equal shapes were cut up each time."""
    parts = spark.createDataFrame([("a", 0, [_ring(0.0, 0.0, 1.0, 1.0)])], "territory string, part int, rings array<array<struct<x:double,y:double>>>")
    assert "RoundRobinPartitioning" in _plan(mesh.build(parts))


def test_thinning_is_dealt_over_tasks(spark):
    """F18, F20."""
    rings = spark.createDataFrame([("a", 0, 0, _ring(0.0, 0.0, 1.0, 1.0))], "territory string, part int, ring int, points array<struct<x:double,y:double>>")
    assert "RoundRobinPartitioning" in _plan(mesh.thin_levels(rings, {"": 0.1}))


@pytest.mark.parametrize("by", [edges.neighbours, edges.touching])
def test_pairs_of_equal_territories_without_broadcast(spark, by):
    """The join by edge was broadcast by the size of a small file, and each pair shuffled once an edge."""
    squares = [(f"{n}{x}", 0, 0, _ring(float(x), 0.0, 1.0, 1.0)) for x in range(3) for n in "abc"]
    e = edges.ring_edges(spark.createDataFrame(squares, "territory string, part int, ring int, points array<struct<x:double,y:double>>"))
    got = by(e)
    assert "BroadcastHashJoin" not in _plan(got)
    want = {tuple(sorted(p)) for p in itertools.combinations([s[0] for s in squares], 2) if abs(int(p[0][1]) - int(p[1][1])) < 2}
    found = {(r.left, r.right): r[2] for r in got.collect()}
    assert set(found) == want
    assert found["a0", "b0"] == 4 and found["a0", "b1"] == (1 if by is edges.neighbours else 2)


def test_equal_shapes_are_overlaid_once(spark, monkeypatch):
    """F5."""
    seen = []
    plain = mesh.triangulate
    monkeypatch.setattr(mesh, "triangulate", lambda parts: seen.append(parts.count()) or plain(parts))
    rows = [(f"t{k}", 0, [_ring(0.0, 0.0, 2.0, 1.0)]) for k in range(5)] + [("u", 0, [_ring(1.0, 0.0, 2.0, 1.0)])]
    got = mesh.part_overlaps(spark.createDataFrame(rows, "territory string, part int, rings array<array<struct<x:double,y:double>>>")).collect()
    assert seen == [2]
    assert {(r.left, r.right): r.area for r in got} == {**{p: 2.0 for p in itertools.combinations([f"t{k}" for k in range(5)], 2)}, **{(f"t{k}", "u"): 1.0 for k in range(5)}}


def test_clip_areas_at_once():
    """pairs of triangles were clipped one by one."""
    rnd = np.random.default_rng(5)
    t, u = rnd.integers(0, 6, (400, 3, 2)).astype(float), rnd.integers(0, 6, (400, 3, 2)).astype(float)
    together = mesh.clip_areas(t, u)
    assert np.allclose(together, [mesh.clip_area(a, b) for a, b in zip(t, u)])
    flat = lambda a: (a[:, 1, 0] - a[:, 0, 0]) * (a[:, 2, 1] - a[:, 0, 1]) == (a[:, 1, 1] - a[:, 0, 1]) * (a[:, 2, 0] - a[:, 0, 0])
    sound = ~flat(t) & ~flat(u)
    assert np.allclose(together[sound], mesh.clip_areas(u, t)[sound]) and together[sound].max() > 0


@pytest.mark.parametrize("query, places", [("points_in_triangles", 1280), ("point_pick", 53_200)])
def test_equal_places_are_looked_up_once(spark, monkeypatch, query, places):
    """every event met every part at its place."""
    seen = []
    plain = grid.level_join
    monkeypatch.setattr(grid, "level_join", lambda left, *a, **k: seen.append(left.count()) or plain(left, *a, **k))
    queries.QUERIES[query](spark, f"{DATA}/sf0.01")
    assert seen and max(seen) <= places and max(seen) < 10_000 + (query == "point_pick")


def test_small_groups_need_no_grid(spark):
    """A row was copied to the cells of all coarser grids, six times a join."""
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0, 9.0), (1, 2, 1.0, 1.0, 2.0, 2.0)], BOX)
    plan = _plan(grid.level_join(boxes, boxes.select("*"), ("g",)))
    assert "Generate" not in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("small", [0, 3, 512])
def test_groups_by_grid_and_whole_give_the_same(spark, monkeypatch, small):
    monkeypatch.setattr(grid, "SMALL", small)
    monkeypatch.setattr(overlay, "SMALL", small)
    rnd = random.Random(3)
    rows = [(g, i, x, y, x + rnd.choice([0.0, 1.0, 7.0]), y + rnd.choice([0.0, 0.5, 9.0])) for g in range(4) for i in range(2 + 3 * g) for x, y in [(rnd.uniform(0, 20), rnd.uniform(0, 20))]]
    boxes = spark.createDataFrame(rows, BOX)
    meet = lambda a, b: a[2] <= b[4] and a[4] >= b[2] and a[3] <= b[5] and a[5] >= b[3]
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and meet(a, b))
    assert sorted((r.g, r.l_id, r.r_id) for r in grid.level_join(boxes, boxes.select("*"), ("g",), 0.5).collect()) == want
    walls = boxes.where("max_x > min_x").select("g", "id", boxes.min_x.alias("low"), boxes.max_x.alias("high"))
    probes = boxes.select("g", "id", boxes.min_x.alias("at"))
    want = sorted((p[0], p[1], w[1]) for p in rows for w in rows if p[0] == w[0] and w[2] < w[4] and w[2] <= p[2] < w[4])
    assert sorted((r.g, r.p_id, r.w_id) for r in grid.stab_join(probes, walls, ("g",)).collect()) == want
    rings = spark.createDataFrame([(g, str(i), 0, 0, _ring(float(i), float(g), 1.5, 1.0)) for g in range(3) for i in range(1 + g)], "grp int, owner string, part int, ring int, points array<struct<x:double,y:double>>")
    areas = {r.grp: round(r.area, 6) for r in overlay.union(rings).groupBy("grp").sum("area").withColumnRenamed("sum(area)", "area").collect()}
    assert areas == {0: 1.5, 1: 2.5, 2: 3.5}


def test_an_account_is_made_once(spark, monkeypatch):
    """parts were read and grouped anew for every step, and a budget made its accounts twice."""
    from regionspark.operators import account

    made = []
    plain = account.part_accounts
    monkeypatch.setattr(account, "part_accounts", lambda *a: made.append(a) or plain(*a))
    got = queries.QUERIES["account_budget"](spark, f"{DATA}/sf0.001")
    assert len(made) == 1 and "lineitem" not in _plan(got)
