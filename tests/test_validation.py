"""One broken fact, one violation; and streams against batch."""

import numpy as np
import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from regionspark.operators import metrics, validate
from regionspark.plans import fixtures
from regionspark.sources import documents
from regionspark.streaming import metrics as live


def _levels(spark, **change):
    base = dict(territory_count=5, triangles=9, source_parts=3, parts=3, source_holes=1, holes=1, largest_dropped=0.0, dropped_area=0.0)
    out = []
    for lod, v in (("high", 1000), ("medium", 400), ("low", 200)):
        out.append({"dataset": "d", "lod": lod, "vertices": v, **base, **change.get(lod, {})})
    return spark.createDataFrame([r for r in out if not r.pop("gone", False)])


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, set()),
        ({"medium": {"gone": True}}, {("missing_level", None)}),
        ({"low": {"territory_count": 4}}, {("territory_count", None)}),
        ({"medium": {"vertices": 1000}}, {("not_coarsening", None)}),
        ({"low": {"vertices": 300}}, {("low_vertex_budget", None)}),
        ({"high": {"parts": 2}}, {("high_parts", None)}),
        ({"high": {"holes": 0}}, {("high_holes", None)}),
        ({"low": {"holes": 2}}, {("invented_holes", "low")}),
        ({"low": {"triangles": 0}}, {("no_triangles", "low")}),
        ({"low": {"largest_dropped": 10001.0}}, {("dropped_part_area", "low")}),
        ({"low": {"dropped_area": 50001.0}}, {("total_dropped_area", "low")}),
    ],
)
def test_ladder(spark, change, want):
    assert {(r.rule, r.lod) for r in validate.ladder(_levels(spark, **change), "dataset").collect()} == want


def test_stage_area_flag_rules(spark):
    s = list(validate.STAGES)
    b = spark.createDataFrame([("a", "high", 2, s, s[:1]), ("b", "high", 3, s, s), ("c", "high", 2, s[:2], s[:2]), ("d", "low", 2, s, ["other"])], "dataset string, lod string, schema_version int, recorded array<string>, event_stages array<string>")
    assert {(r.dataset, r.rule) for r in validate.stages(b, "dataset").collect()} == {("b", "schema_version"), ("c", "missing_stage"), ("d", "unlisted_stage")}
    names = "dataset lod source_area output_area removed_area added_area stated_removed stated_added retained".split()
    good = ("a", "high", 100.0, 95.0, 10.0, 5.0, 10.0, 5.0, 0.95)
    broken = [good, ("b", *good[1:3], 90.0, *good[4:8], 0.9), ("c", *good[1:6], 20.0, *good[7:]), ("d", *good[1:7], 9.0, good[8]), ("e", *good[1:8], 0.5)]
    got = {(r.dataset, r.rule) for r in validate.area_budget(spark.createDataFrame(broken, names), "dataset").collect()}
    assert got == {("b", "area_balance"), ("c", "stated_removed"), ("d", "stated_added"), ("e", "retained_ratio")}
    f = spark.createDataFrame([("a", "low", True, True, True), ("b", "low", False, True, True), ("c", "low", None, True, False), ("d", "high", True, True, True)], "dataset string, lod string, declared_lossy boolean, lossy boolean, picking_unsafe boolean")
    assert {(r.dataset, r.rule) for r in validate.declared_flags(f, "dataset").collect()} == {("b", "declared_lossy"), ("c", "lossy_but_safe"), ("d", "lossy_high")}


def test_normalization_and_sentinels(spark):
    schema = "dataset string, kind string, count long, details array<string>"
    drops = spark.createDataFrame([("a", "dropped_islet", 2, ["x", "y"]), ("b", "dropped_islet", 21, ["z"])], schema)
    up = drops.crossJoin(spark.createDataFrame([(x,) for x in validate.LODS], "lod string")).select("dataset", "lod", "kind", "count", "details")
    up = up.where("not (dataset = 'a' and lod = 'low')")
    assert {(r.dataset, r.lod, r.rule) for r in validate.normalization(drops, up, "dataset").collect()} == {("b", None, "too_many_drops"), ("a", "low", "upstream_events")}
    have = spark.createDataFrame([("high", "vertices", 10)], "lod string, field string, found int")
    want = spark.createDataFrame([("high", "vertices", 10), ("low", "vertices", 3)], "lod string, field string, expected int")
    bad = validate.pinned(have, want)
    assert [(r.lod, r.expected, r.found) for r in bad.collect()] == [("low", 3, None)]
    with pytest.raises(validate.ValidationError):
        validate.require_empty(bad, "sentinels")
    validate.require_empty(bad.limit(0), "sentinels")


def test_self_crossing_rings(spark):
    ring = lambda *p: [(float(x), float(y)) for x, y in [*p, p[0]]]
    shapes = {
        "square": ring((0, 0), (1, 0), (1, 1), (0, 1)),
        "bowtie": ring((0, 0), (1, 1), (1, 0), (0, 1)),
        "touch": ring((0, 0), (2, 0), (2, 2), (1, 0), (0, 2)),
        "spike": ring((0, 0), (2, 0), (1, 0), (1, 1)),
    }
    t = np.linspace(0, 2 * np.pi, 500, endpoint=False)
    shapes["circle"] = ring(*zip(np.cos(t), np.sin(t)))
    df = spark.createDataFrame([("d", k, [[v]]) for k, v in shapes.items()], f"dataset string, id string, geometry {documents.GEOMETRY}")
    assert {r.id for r in documents.self_crossing(df).collect()} == {"bowtie", "touch", "spike"}
    with pytest.raises(documents.DatasetError, match="crosses itself"):
        documents.require_valid(df.where("id in ('square', 'touch')"))
    assert documents.require_valid(df.where("id in ('square', 'circle')")).count() == 2


def test_streamed_latency_equals_batch(spark, tmp_path):
    r = fixtures.requests(spark, f"{DATA}/sf0.001")
    r.repartition(3).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.latest_latency(src, 50).writeStream.format("memory").queryName("latency_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    want = metrics.latency(r, 50).toPandas()
    last = spark.table("latency_out").toPandas().groupby("route").tail(1)
    assert rows(last) == rows(want)
    n = live.windowed_counts(spark.readStream.schema(r.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("counts_out").option("checkpointLocation", str(tmp_path / "cp2")).outputMode("complete").start()
    n.processAllAvailable()
    n.stop()
    assert spark.table("counts_out").agg(F.sum("n")).first()[0] == r.count()


def test_snapshot_prunes_and_lists(spark, tmp_path):
    from regionspark.operators import reports

    m = spark.createDataFrame([("d", f"r{i % 2}", "high", f"x{i:03}", None, None) for i in range(40)], "dataset string, revision_id string, lod string, id string, neighbor_ids array<string>, lossy boolean")
    reports.write_snapshot(m, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    one = back.where("revision_id = 'r1' and id > 'x010'")
    plan = one._jdf.queryExecution().toString()
    assert one.count() == 15 and "PartitionFilters: [isnotnull(revision_id" in plan and "GreaterThan(id,x010)" in plan
    shown = reports.public_fields(back.withColumns({"name": F.col("id"), "parent_id": F.lit(None).cast("string"), "level": F.lit(1)}))
    assert {(tuple(r.neighbor_ids), r.lossy) for r in shown.collect()} == {((), False)}
    groups = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "x"), ("b", "y")], "dataset string, shape_group string")
    assert [(r.dataset, r.groups) for r in reports.mixed_groups(groups).collect()] == [("b", ["x", "y"])]
    busy = spark.createDataFrame([("a", 1, 0, 0), ("b", 1, 1, 1), ("c", 0, 0, 1)], "territory string, merges int, splits int, created int")
    assert [r.territory for r in reports.busiest_regions(busy).collect()] == ["b", "a", "c"]
    assert spark.range(1).select(reports.mismatched_segments(F.lit(3), F.lit(5))).first()[0] == 0


def _document(tmp_path, shapes):
    import json

    features = [{"type": "Feature", "properties": {"id": k}, "geometry": {"type": "MultiPolygon", "coordinates": [[[*map(list, r), list(r[0])] for r in part] for part in parts]}} for k, parts in shapes.items()]
    (tmp_path / "d.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return str(tmp_path)


def test_repair_policy(spark, tmp_path):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    shapes = {
        "sound": [[square, [(1, 1), (1, 2), (2, 2)]]],
        "tie": [[[(0, 0), (4, 4), (4, 0), (0, 4)]]],
        "spike": [[[(0, 0), (4, 0), (4, 4), (4, 9), (4, 4), (0, 4)]]],
        "outside": [[square, [(9, 9), (10, 9), (10, 10), (9, 10)]]],
    }
    path = _document(tmp_path, shapes)
    got = {r["id"]: r for r in documents.load_dataset(spark, path, "repair").collect()}
    assert {k: r["repaired"] for k, r in got.items()} == {"sound": False, "tie": True, "spike": True, "outside": True}
    assert {k: len(r["geometry"]) for k, r in got.items()} == {"sound": 1, "tie": 2, "spike": 1, "outside": 2}
    assert [(p["x"], p["y"]) for p in got["sound"]["geometry"][0][0]] == [*square, square[0]]
    assert all(ring[0] == ring[-1] for r in got.values() for part in r["geometry"] for ring in part)
    assert {(p["x"], p["y"]) for p in got["spike"]["geometry"][0][0]} == set(square)
    again = documents.load_dataset(spark, path, "repair").drop("repaired")
    assert documents.require_valid(again).count() == 4
    with pytest.raises(ValueError, match="on_invalid"):
        documents.load_dataset(spark, path, "ignore")


def test_what_no_policy_can_load(spark, tmp_path):
    path = _document(tmp_path, {"line": [[[(0, 0), (3, 3), (6, 6)]]], "ok": [[[(0, 0), (1, 0), (1, 1)]]]})
    with pytest.raises(Exception, match="no usable surface: d/line"):
        documents.load_dataset(spark, path, "repair").collect()
    with pytest.raises(documents.DatasetError, match="line: crosses itself"):
        documents.load_dataset(spark, path)
