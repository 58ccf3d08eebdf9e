"""Functions and kernels against independent small versions."""

import gzip
import json
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from regionspark.functions import projection as P
from regionspark.functions import requests as Q
from regionspark.functions import rings as R
from regionspark.operators import account, grid, ledger, mesh, paging, publish, reports
from regionspark.sources import documents, meshes
from regionspark.streaming import viewport


def test_worked_projection_example(spark):
    d = lambda x: F.lit(float(x))
    r = spark.range(1).select(
        P.project_x(d(28.9784), d(32.8597), d(39.9334)).alias("x"), P.project_y(d(41.0082), d(39.9334)).alias("y"), P.local_scale(d(39.9334)).alias("s")
    ).first()
    assert round(r.x, 2) == -331303.09 and round(r.y, 2) == 120602.72 and round(r.s, 6) == 0.766791


@pytest.mark.parametrize("lat", [86.0, float("nan"), None])
def test_bad_latitude_is_an_error(spark, lat):
    with pytest.raises(Exception, match="latitude out of range"):
        spark.createDataFrame([(lat,)], "lat double").select(P.check_latitude(F.col("lat"))).collect()


@pytest.mark.parametrize("text", ["1,2,3", "a,0,1,1", "2,0,1,1", "nan,0,1,1", "0,0,inf,1", ""])
def test_bad_boxes(text):
    with pytest.raises(Q.RequestError, match="invalid_bbox"):
        Q.parse_bbox(text)


def test_cursor_round_trip_and_mismatch():
    t = Q.encode_cursor("r", "high", "x:1", {"bbox": "0,0,1,1"})
    assert Q.resume(t, "r", "high", {"bbox": "0,0,1,1"}) == "x:1" and "=" not in t
    with pytest.raises(Q.RequestError, match="cursor_filter_mismatch"):
        Q.resume(t, "r", "low", {"bbox": "0,0,1,1"})
    with pytest.raises(Q.RequestError, match="invalid_cursor"):
        Q.resume("###", "r", "low", {})


def test_page_walk_visits_each_match_once(spark):
    ids = [f"{i:03}" for i in range(60)]
    e = spark.createDataFrame([(i, int(i) % 7) for i in ids], "id string, k int").cache()
    for limit, cap in ((3, 5000), (4, 5), (50, 7)):
        after, seen = None, []
        for _ in range(100):
            p = paging.page_info(e, F.col("k") == 3, limit, after, cap).first()
            seen += p.ids
            if not p.has_more:
                break
            after = p.last_scanned_id
        assert seen == [i for i in ids if int(i) % 7 == 3]
    assert paging.page_info(e, F.col("k") == 3, 5, "999").first() == ([], None, False, False)
    assert [r.id for r in paging.paginate(e, F.col("k") == 3, 2).collect()] == ["003", "010"]
    with pytest.raises(ValueError):
        paging.paginate(e, F.lit(True), 0)


def test_grid_join_equals_theta_join(spark):
    rng = random.Random(4)
    boxes = []
    for i in range(250):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        boxes.append((i, x, y, x + rng.choice([0, 1, 5, 30]), y + rng.uniform(0, 4)))
    df = spark.createDataFrame(boxes, "id int, min_x double, min_y double, max_x double, max_y double")
    got = {(r.l_id, r.r_id) for r in grid.box_join(df, df, grid.cell_size(df)).collect()}
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]}
    assert got == want


def _account(spark, src, out):
    s = spark.createDataFrame([("t", i, *map(float, b)) for i, b in enumerate(src)], "territory string, part int, x0 double, y0 double, x1 double, y1 double")
    o = spark.createDataFrame([("t", i, *map(float, b)) for i, b in enumerate(out)], s.schema)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    ev = account.account_events(s.withColumn("area", area), o.withColumn("area", area), account.box_overlaps(s, o)).collect()
    return {r.kind: (r["count"], round(r.area, 9)) for r in ev}


def test_accounting_counterexamples(spark):
    box = lambda x, y, s: (x, y, x + s, y + s)
    # equal numbers of parts hide no loss
    assert _account(spark, [box(30, 39, 10), box(50, 39, 5)], [box(30, 39, 10), box(70, 39, 5)]) == {"dropped_part": (1, 25), "part_created": (1, 25)}
    # touching in a corner is no survival
    got = _account(spark, [box(0, 0, 2)], [box(2, 2, 5)])
    assert got["dropped_part"] == (1, 4) and got["part_created"] == (1, 25)
    # two parts become one, one becomes three
    assert _account(spark, [(0, 0, 5, 5), (6, 0, 11, 5)], [(0, 0, 11, 5)]) == {"part_merge": (1, 5)}
    assert _account(spark, [(0, 0, 11, 5)], [(0, 0, 3, 5), (4, 0, 7, 5), (8, 0, 11, 5)]) == {"part_split": (2, 10)}
    # 11 % survives as a severe shrink, 9 % is gone and made anew
    assert _account(spark, [box(0, 0, 10)], [(0, 0, 10, 1.1)]) == {"boundary_retreat": (1, 89), "severe_shrink": (1, 0)}
    assert set(_account(spark, [box(0, 0, 10)], [(0, 0, 10, 0.9)])) == {"dropped_part", "part_created"}
    assert _account(spark, [box(0, 0, 10)], [box(0, 0, 10)]) == {}


def test_each_broken_identity_is_found(spark):
    names = "source_area output_area removed_area added_area measured_removed measured_added source_parts parts dropped merges splits created source_holes holes dropped_holes hole_merges hole_splits".split()
    good = dict(zip(names, [100.0, 95.0, 10.0, 5.0, 10.0, 5.0, 3, 2, 1, 1, 0, 1, 2, 1, 1, 0, 0]))
    bad = {"ok": {}, "area_balance": {"output_area": 90.0}, "removed_measure": {"measured_removed": 15.0}, "added_measure": {"measured_added": 0.0}, "part_count": {"splits": 1}, "hole_count": {"dropped_holes": 0}}
    df = spark.createDataFrame([{"territory": k, **good, **v} for k, v in bad.items()])
    assert {(r.territory, r.rule) for r in account.budget_violations(df).collect()} == {(k, k) for k in bad if k != "ok"}
    six = spark.createDataFrame([("t", 9999.0)] * 6, "territory string, area double")
    assert [r.rule for r in account.gate_violations(six).collect()] == ["total_dropped_area"]


def _polygon(rng, n, r=10.0):
    a = np.sort(rng.uniform(0, 2 * math.pi, n))
    d = rng.uniform(0.3 * r, r, n)
    return np.stack([np.cos(a) * d, np.sin(a) * d], axis=1)


def _area(p):
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def test_triangulation_of_random_polygons():
    rng = np.random.default_rng(2)
    for _ in range(60):
        p = _polygon(rng, int(rng.integers(3, 60)))
        turn = np.sort(np.arctan2(p[:, 1], p[:, 0]))
        if np.diff(np.append(turn, turn[0] + 2 * math.pi)).max() > 3:  # the centre is outside: perhaps no simple polygon
            continue
        t = mesh.triangulate_part([p])
        c = p[t]
        area = mesh._cross(c[:, 0], c[:, 1], c[:, 2]) / 2
        assert len(t) == len(p) - 2 and (area >= 0).all() and abs(area.sum() - _area(p)) < 1e-9 * 400
    outer = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    holes = [np.array([[x, y], [x, y + 2], [x + 2, y + 2], [x + 2, y]], float) for x, y in ((1, 1), (5, 5), (5, 1))]
    t = mesh.triangulate_part([outer, *holes])
    c = np.concatenate([outer, *holes])[t]
    assert len(t) == 16 + 2 * 3 - 2 and abs((mesh._cross(c[:, 0], c[:, 1], c[:, 2]) / 2).sum() - 88) < 1e-9


def test_clip_area_of_rectangle_halves():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = rng.integers(0, 6, 4).astype(float)
        a = (x[0], 0.0, x[0] + 3, 4.0)
        b = (x[1], x[2] - 2, x[1] + 2, x[2] + x[3])
        halves = lambda r: [np.array([(r[0], r[1]), (r[2], r[1]), (r[2], r[3])]), np.array([(r[0], r[1]), (r[2], r[3]), (r[0], r[3])])]
        want = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        assert abs(sum(mesh.clip_area(t, u) for t in halves(a) for u in halves(b)) - want) < 1e-12


def test_simplify_leaves_no_cracks(spark):
    rng = np.random.default_rng(9)
    border = np.stack([5 + rng.uniform(-0.4, 0.4, 60), np.linspace(0, 10, 60)], axis=1)
    left = np.concatenate([[[0, 0]], border, [[0, 10]]])
    right = np.concatenate([border[::-1], [[10, 0], [10, 10]]])
    pts = lambda a: [(float(x), float(y)) for x, y in a]
    df = spark.createDataFrame([("l", 0, 0, pts(left)), ("r", 0, 0, pts(right))], "territory string, part int, ring int, points array<struct<x:double,y:double>>")
    got = {r.territory: np.array([(p.x, p.y) for p in r.points]) for r in mesh.simplify(df, 0.2).collect()}
    sides = [{tuple(p) for p in g if 0 < p[0] < 10} for g in got.values()]
    assert sides[0] == sides[1] and 2 < len(sides[0]) < 60
    assert abs(_area(got["l"]) + abs(_area(got["r"])) - 100) < 1e-9


def test_mesh_bytes():
    v = np.array([[0, 0], [4, 0], [4, 3], [0, 3]], float)
    raw = meshes.encode(v, np.array([[0, 1, 2], [0, 2, 3]]))
    assert len(raw) == 32 + 8 * 4 + 2 * 6 and raw[:4] == b"TKMS"
    got, t = meshes.decode(raw + b"more", strict=True)
    assert (got == v).all() and mesh._cross(*(got[t][:, i] for i in range(3))).max() < 0
    for bad in (raw[:40], b"XXXX" + raw[4:], raw[:8] + b"\xff" + raw[9:], raw[:16] + b"\0\0\x80?" + raw[20:]):
        with pytest.raises(meshes.MeshError):
            meshes.decode(bad)
    for vs, ts in ((v[:2], [[0, 1, 1]]), (v, [[0, 1, 9]]), (v * np.nan, [[0, 1, 2]]), (v, [[0, 1, 1]]), (v, [[0.0, 1.0, 2.0]])):
        with pytest.raises(meshes.MeshError):
            meshes.encode(vs, np.array(ts))
    big = np.random.default_rng(0).uniform(0, 1, (70_000, 2))
    assert len(meshes.encode(big, np.array([[0, 1, 2]]))) == 32 + 8 * 70_000 + 12


@pytest.mark.parametrize("zipped", [False, True])
def test_batch_bytes(spark, zipped):
    found, missing = meshes.decode_batch(meshes.encode_batch({"b": b"22", "a": b"1"}, ["z", "y", "z"], zipped))
    assert found == {"a": b"1", "b": b"22"} and missing == ["y", "z"]
    want = spark.createDataFrame([(1, "a"), (1, "q"), (2, "b")], "batch int, id string")
    have = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"22"))], "id string, payload binary")
    got = {r.batch: meshes.decode_batch(bytes(r.container)) for r in meshes.batch_meshes(want, have, zipped).collect()}
    assert got == {1: ({"a": b"1"}, ["q"]), 2: ({"b": b"22"}, [])}
    with pytest.raises(meshes.MeshError):
        meshes.decode_batch(b"TKMB")
    assert gzip.compress(b"x", 9, mtime=0) == gzip.compress(b"x", 9, mtime=0)


def test_levels_and_sweep():
    level, got = 0, []
    for z in (10, 65e3, 50e3, 44e3, 200e3, 150e3, 139e3, 10):
        level = viewport.select_level(level, z)
        got.append(viewport.LEVELS[level])
    assert got == "high medium medium high low low medium high".split()
    for bad in (((2, 1),), ((1, float("nan")),), ((5, 6), (1, 2))):
        with pytest.raises(ValueError):
            viewport.check_thresholds(bad)


def test_stream_equals_replay(spark, tmp_path):
    rng = random.Random(3)
    ticks = [(f"s{rng.randrange(5)}", i, rng.choice([10.0, 50e3, 70e3, 150e3, 190e3]), x := rng.randrange(30) * 5.0, y := rng.randrange(30) * 5.0, x + 100, y + 60) for i in range(400)]
    df = spark.createDataFrame(ticks, "session string, seq long, zoom double, min_x double, min_y double, max_x double, max_y double")
    want = rows(viewport.replay(df).toPandas())
    for k in range(4):
        df.where(f"seq >= {100 * k} and seq < {100 * k + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = viewport.stream(live).writeStream.format("memory").queryName("ticks_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("ticks_out").toPandas()) == want


def test_documents(spark, tmp_path):
    square = lambda x, s=1: [[[x, 0], [x + s, 0], [x + s, s], [x, s], [x, 0]]]
    geo = {
        "type": "FeatureCollection",
        "metadata": {"id": "tr"},
        "features": [
            {"type": "Feature", "properties": {"shapeID": "a", "shapeName": "A"}, "geometry": {"type": "Polygon", "coordinates": square(0)}},
            {"type": "Feature", "properties": {"id": ""}, "geometry": {"type": "MultiPolygon", "coordinates": [square(2), square(4, 0.5)]}},
            {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 1]}},
        ],
    }
    zones = {"manifest": {"datasetId": "z"}, "zones": [{"id": "p", "childIds": ["c", 3], "level": 1}, {"id": "c", "properties": {"name": "C"}, "geometry": {"type": "Polygon", "coordinates": square(0)}}, {"id": "q", "childIds": ["c"]}]}
    (tmp_path / "geo.json").write_text(json.dumps(geo))
    (tmp_path / "zones.json").write_text(json.dumps(zones))
    got = {(r.dataset, r.id): r for r in documents.load(spark, str(tmp_path)).collect()}
    assert got["tr", "a"].name == "A" and len(got["tr", "tr-1"].geometry) == 2 and got["tr", "tr-2"].geometry is None
    assert got["z", "c"].parent_id == "q" and got["z", "c"].name == "C" and got["z", "p"].level == 1
    bad = {(r.id, r.problem) for r in documents.geometry_problems(documents.load(spark, str(tmp_path))).collect()}
    assert ("tr-2", "missing_or_unsupported") in bad and not any(i == "a" for i, _ in bad)
    (tmp_path / "x.json").write_text("[1]")
    with pytest.raises(Exception, match="not a JSON object"):
        documents.load(spark, str(tmp_path)).collect()


def test_names_and_digests(spark):
    ids = spark.createDataFrame([(x,) for x in ("a/b", "A_B", "con", "x. ", "x", "é", "...")], "id string")
    got = {r.id: r.name for r in publish.unique_names(ids).collect()}
    assert got["con"] == "_con" and len({n.lower() for n in got.values()}) == len(got)
    one = lambda *v: spark.range(1).select(publish.short_digest(*[F.lit(x) for x in v])).first()[0]
    assert len(one("a", "b")) == 24 and one("a", "b") != one("ab", "") and one(None) != one("")


def test_rings(spark):
    g = [[[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)], [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0)]], [[(5.0, 5.0), (5.0 + 1e-6, 5.0), (5.0, 5.0 + 1e-6)]]]
    df = spark.createDataFrame([(g,)], f"g {R.GEOMETRY}")
    r = df.select(R.interior_area(F.col("g")).alias("i"), R.polygon_area(F.col("g")[0]).alias("p"), F.size(R.drop_small(F.col("g"), 1e-9)).alias("n"), R.hole_count(F.col("g")).alias("h")).first()
    assert (r.i, r.p, r.n, r.h) == (0.125, 3.875, 1, 1)
    flat = spark.createDataFrame([([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)],)], f"r {R.RING}")
    assert flat.select(R.prepare_ring(F.col("r"), True).alias("x")).first().x is None


def test_hole_correspondence(spark):
    box = lambda x, y, s: tuple(map(float, (x, y, x + s, y + s)))

    def events(src, out):
        s = spark.createDataFrame([("t", i, *b) for i, b in enumerate(src)], "territory string, part int, x0 double, y0 double, x1 double, y1 double")
        o = spark.createDataFrame([("t", i, *b) for i, b in enumerate(out)], s.schema)
        area = ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area")
        h = lambda df: df.select("territory", F.col("part").alias("hole"), area)
        return {r.kind: (r["count"], r.area) for r in account.hole_events(h(s), h(o), account.box_overlaps(s, o)).collect()}

    assert events([box(0, 0, 2)], []) == {"dropped_hole": (1, 4.0)}
    assert events([], [box(0, 0, 2)]) == {"artifact_hole_removed": (1, 4.0)}
    assert events([box(0, 0, 2)], [box(0, 0, 2)]) == {}
    assert events([box(0, 0, 2), box(3, 0, 2)], [(0.0, 0.0, 5.0, 2.0)]) == {"hole_merge": (1, 0.0)}
    assert events([(0.0, 0.0, 8.0, 2.0)], [box(0, 0, 2), box(3, 0, 2), box(6, 0, 2)]) == {"hole_split": (2, 0.0)}


def _plain_ears(p):
    """Ear clipping by the book, for comparison."""
    poly, out = list(range(len(p))), []
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    while len(poly) > 2:
        for k in range(len(poly)):
            i, j, m = poly[k - 1], poly[k], poly[(k + 1) % len(poly)]
            if turn(p[i], p[j], p[m]) > 0 and not any(turn(p[i], p[j], p[v]) >= 0 and turn(p[j], p[m], p[v]) >= 0 and turn(p[m], p[i], p[v]) >= 0 for v in poly if v not in (i, j, m)):
                out.append((i, j, m))
                del poly[k]
                break
        else:
            raise AssertionError("no ear")
    return out


def test_ears_of_large_and_crossing_shapes():
    rng = np.random.default_rng(8)
    for n in (3, 4, 7, 40, 90):
        p = _polygon(rng, n)
        tri, plain = mesh.triangulate_part([p]), _plain_ears(p.tolist())
        area = lambda t: sum(abs(_area(p[list(x)])) for x in t)
        assert len(tri) == len(plain) == n - 2 and abs(area(tri) - area(plain)) < 1e-9
    big = _polygon(rng, 3000)
    tri = mesh.triangulate_part([big])
    assert len(tri) == 2998 and abs(sum(abs(_area(big[t])) for t in tri) - _area(big)) < 1e-6
    for bow in ([[0, 0], [4, 4], [4, 0], [0, 4]], [[0, 0], [4, 4], [4, 0], [0, 2]], [[0, 2], [4, 0], [4, 4], [0, 0]]):
        with pytest.raises(ValueError):
            mesh.triangulate_part([np.array(bow, float)])


def test_triangulation_reports_what_it_loses(spark):
    point = lambda p: {"x": float(p[0]), "y": float(p[1])}
    square, flat = [(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(0, 0), (1, 1), (2, 2)]
    rows = [("a", 0, [square]), ("a", 1, [flat]), ("b", 0, [square, flat]), ("c", 0, None), ("d", 0, []), ("e", 0, [[(0, 0), (4, 4), (4, 0), (0, 2)]]), ("f", 0, [None]), ("f", 1, [square[::-1], [(1, 1), (2, 1), (2, 2), (1, 2)]])]
    df = spark.createDataFrame([(n, k, r and [x and [point(p) for p in x] for x in r]) for n, k, r in rows], "territory string, part int, rings array<array<struct<x:double,y:double>>>")
    built = mesh.build(df).cache()
    got = {(r.territory, r.kind): (r["count"], r.area) for r in mesh.triangulation_events(built).collect()}
    assert got == {("a", "skipped_part"): (1, 0.0), ("b", "skipped_ring"): (1, 0.0), ("c", "skipped_part"): (1, 0.0), ("d", "skipped_part"): (1, 0.0), ("e", "skipped_part"): (1, 4.0), ("f", "skipped_part"): (1, 0.0)}
    assert mesh.empty_parts(built).count() == 0
    n = {(r.territory, r.part): len(r.triangles) // 3 for r in built.collect()}
    assert n[("a", 0)] == n[("b", 0)] == 2 and n[("f", 1)] == 8 and n[("e", 0)] == 0
    owners = {(r.territory, r.part) for r in mesh.part_owners(built).collect()}
    assert owners == {("a", 0), ("b", 0), ("f", 1)}


def test_names_never_clash(spark):
    ids = ["a", "A", "a-2", "A-2", "a-2-2", "a-3", "A-3", "b", "a-2-3", "aux", "AUX", "a/b", "a?b"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r.id: r.name for r in publish.unique_names(df).collect()}
    taken, want = set(), {}
    for i in sorted(ids):
        stem = df.where(F.col("id") == i).select(publish.file_stem(F.col("id"))).first()[0]
        name, n = stem, 2
        while name.lower() in taken:
            name, n = f"{stem}-{n}", n + 1
        taken.add(name.lower())
        want[i] = name
    assert got == want and len({n.lower() for n in got.values()}) == len(ids)


def test_texts_of_requests_and_reports(spark):
    one = spark.range(1)
    assert one.select(Q.format_bbox(*[F.lit(x) for x in (0.1, -2.0, -0.0, 1e10)])).first()[0] == "0.1,-2,0,1E10"
    assert reports.canonical_json({"b": 1, "a": {"é": [1.5]}}) == '{\n  "a": {\n    "é": [\n      1.5\n    ]\n  },\n  "b": 1\n}\n'
    rows = [("x", "high", 0.1, 10.0, 9.0, 2.0, 1.0, 0.5, 3, 2, 1, 1, ["part_merge"])]
    names = "id lod tolerance source_area output_area removed_area added_area dropped_part_area source_parts parts source_holes holes topology_changes".split()
    block = json.loads(reports.simplification_block(spark.createDataFrame(rows, names), "id").first().block)
    assert block["retainedAreaRatio"] == 0.9 and block["areaBudget"] == {"source": 10.0, "output": 9.0, "removed": 2.0, "added": 1.0, "droppedParts": 0.5} and block["topologyChanges"] == ["part_merge"]


def test_only_upstream_events_are_taken(spark):
    e = spark.createDataFrame([("upstream", 1)], "stage string, count int")
    assert ledger.upstream_only(e).count() == 1
    with pytest.raises(Exception, match="upstream events only"):
        ledger.upstream_only(e.unionByName(spark.createDataFrame([("triangulation", 1)], e.schema))).collect()
