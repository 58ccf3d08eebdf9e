"""Queries of small operators: caches, errors, names, projected geometries, decoded meshes, overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from .._store import spread
from ..functions import projection as P
from ..functions import requests as Q
from ..functions import rings as R
from ..operators import mesh, publish, service
from ..sources import meshes
from . import fixtures as fx
from .queries import _meshes, query


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, lod FROM part CROSS JOIN (VALUES ('high'), ('low')) t(lod) WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0 AND lod = 'low'")
def cache_misses(spark, d):
    """What a read-through cache still has to fetch of all wanted meshes."""
    p = fx.table(spark, d, "part").select(F.lit("d").alias("dataset"), F.lit("r").alias("revision_id"), F.explode(F.array(F.lit("high"), F.lit("low"))).alias("lod"), F.col("p_partkey").cast("string").alias("id"), "p_partkey")
    held = p.where(~((F.col("p_partkey") % 3 == 0) | (F.col("p_partkey") % 5 == 0) & (F.col("lod") == "low")))
    return service.missing_from_cache(p.drop("p_partkey"), held.drop("p_partkey")).select("id", "lod")


_CODES = ("dataset_not_found", "revision_gone", "invalid_bbox", "missing_lod", "disk_on_fire", "revision_corrupted")


@query(
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'dataset_not_found' WHEN 1 THEN 'revision_gone' WHEN 2 THEN 'invalid_bbox' WHEN 3 THEN 'missing_lod' WHEN 4 THEN 'internal_error' ELSE 'revision_corrupted' END AS code, "
    "CASE event_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 400 WHEN 3 THEN 422 ELSE 500 END AS status FROM events"
)
def error_responses(spark, d):
    """Failures by code with their status; unknown ones are internal errors."""
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("event_id") % 6 + 1).cast("int"))
    return service.as_errors(fx.table(spark, d, "events").select("event_id", code.alias("code"))).select("event_id", "code", "status")


@query(
    """WITH s AS (SELECT 'n' || CAST(c_nationkey AS VARCHAR) || 'x' || translate(CAST(c_custkey AS VARCHAR), '0123456789', '?*:;,+=!@#') AS id, 'n' || CAST(c_nationkey AS VARCHAR) || 'x' || repeat('_', length(CAST(c_custkey AS VARCHAR))) AS stem FROM customer)
 SELECT id, CASE WHEN row_number() OVER w = 1 THEN stem ELSE stem || '-' || CAST(row_number() OVER w AS VARCHAR) END AS name FROM s WINDOW w AS (PARTITION BY stem ORDER BY id)"""
)
def unique_file_names(spark, d):
    """Ids of other scripts, whose stems are alike, numbered in order."""
    n, k = F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
    ids = fx.table(spark, d, "customer").select(F.concat(F.lit("n"), n, F.lit("x"), F.translate(k, "0123456789", "?*:;,+=!@#")).alias("id"))
    return publish.unique_names(ids).select("id", "name")


@query(
    """WITH a AS (SELECT l_orderkey, max(l_shipdate) AS seen FROM lineitem GROUP BY 1),
 e AS (SELECT CAST(o_custkey % 3 AS INTEGER) AS cache, CAST(o_orderkey AS VARCHAR) AS name, CAST(floor(o_totalprice) AS BIGINT) AS bytes, greatest(o_orderdate, coalesce(seen, o_orderdate)) AS used FROM orders LEFT JOIN a ON l_orderkey = o_orderkey),
 t AS (SELECT *, sum(bytes) OVER (PARTITION BY cache) AS total, coalesce(sum(bytes) OVER (PARTITION BY cache ORDER BY used, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM e) SELECT cache, name, bytes FROM t WHERE total - gone > 100000000"""
)
def recency_eviction(spark, d):
    """Few large caches; an access counts as a touch."""
    o, li = fx.table(spark, d, "orders"), fx.table(spark, d, "lineitem")
    cache, name = (F.col("o_custkey") % 3).cast("int").alias("cache"), F.col("o_orderkey").cast("string").alias("name")
    e = o.select(cache, name, F.floor("o_totalprice").cast("long").alias("bytes"), F.col("o_orderdate").alias("mtime"))
    accesses = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(cache, name, F.col("l_shipdate").alias("at"))
    return publish.evict(e, 100_000_000, accesses)


@query(
    f"""WITH {fx.TERRITORIES_SQL}, {fx.RINGS_SQL}, x AS (SELECT territory, part, ring, x0, y0, x1, y1, olon, olat, cos(radians(olat)) AS sc FROM rects CROSS JOIN org)
 SELECT territory, part, ring, CAST(floor((6378137.0::DOUBLE * radians(x1) - 6378137.0::DOUBLE * radians(x0)) * sc * (6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(y1) / 2)) - 6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(y0) / 2))) * sc / 1000 + 0.5) AS BIGINT) AS area_1000, true AS back FROM x"""
)
def projected_geometries(spark, d):
    """Whole geometries in local metres: areas of their rings in thousands of square metres, and whether they come back to their degrees."""
    t = fx.territories(spark, d)
    o = P.dataset_origin(t).select(P.origin(F.col("origin_lon"), F.col("origin_lat")).alias("o"))
    g = fx.geometries(spark, d).crossJoin(F.broadcast(o))
    lon, lat = F.col("o.lon"), F.col("o.lat")
    g = g.withColumn("local", P.project_geometry(F.col("geometry"), lon, lat))
    g = g.withColumn("again", P.unproject_geometry(F.col("local"), lon, lat))
    parts = g.select("territory", F.posexplode(F.arrays_zip("geometry", "local", "again")).alias("part", "p")).select("territory", "part", F.posexplode(F.arrays_zip("p.geometry", "p.local", "p.again")).alias("ring", "r"))
    near = F.forall(F.zip_with("r.geometry", "r.again", lambda a, b: F.greatest(F.abs(a["x"] - b["x"]), F.abs(a["y"] - b["y"])) < 1e-9), lambda ok: ok)
    return parts.select("territory", "part", "ring", F.floor(F.abs(R.signed_area(F.col("r.local"))) / 1000 + 0.5).cast("long").alias("area_1000"), near.alias("back"))


@query(
    f"""WITH {fx.TERRITORIES_SQL}, {fx.RINGS_SQL}, a AS (SELECT territory, part, sum(CASE WHEN ring = 0 THEN 1 ELSE -1 END * (x1 - x0) * (y1 - y0)) AS area, count(*) AS rings FROM rects GROUP BY territory, part)
 SELECT territory, CAST(sum(4 * rings + 2 * (rings - 1) - 2) AS BIGINT) AS triangles, CAST(floor(sum(area) * 10000 + 0.5) AS BIGINT) AS area_e4 FROM a GROUP BY territory"""
)
def decoded_meshes(spark, d):
    """Triangles read back from binary meshes."""
    t = meshes.mesh_triangles(_meshes(spark, d))
    area = F.abs(R.triangle_cross(*[F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy")])) / 2
    return t.groupBy("territory").agg(F.count(F.lit(1)).alias("triangles"), F.floor(F.sum(area) * 10_000 + 0.5).cast("long").alias("area_e4"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS territory, 'degenerate_triangle' AS kind, CAST(1 AS BIGINT) AS count, CAST(2 AS BIGINT) AS triangles FROM customer WHERE c_custkey % 4 = 1")
def degenerate_triangles(spark, d):
    """Squares with a vertex that lies almost on a side: the triangle it makes has no area worth keeping."""
    c = F.col("c_custkey")
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), (y if not isinstance(y, (int, float)) else F.lit(float(y))).alias("y"))
    ring = F.array(point(0, 0), point(4, F.when(c % 4 == 1, -1e-11).otherwise(-1.0)), point(8, 0), point(8, 8), point(0, 8))
    built = mesh.build(spread(fx.table(spark, d, "customer")).select(c.cast("string").alias("territory"), F.lit(0).alias("part"), F.array(ring).alias("rings")))
    kept = built.select("territory", F.floor(F.size("triangles") / 3).alias("triangles"))
    return mesh.triangulation_events(built).join(kept, "territory").select("territory", "kind", "count", "triangles")


@query(
    """WITH RECURSIVE s AS (SELECT c_custkey, c_name, length(c_name) AS n, 0 AS i, CAST(2166136261 AS BIGINT) AS h FROM customer
  UNION ALL SELECT c_custkey, c_name, n, i + 1, (xor(h, CAST(ascii(substr(c_name, i + 1, 1)) AS BIGINT)) * 16777619) & 4294967295 FROM s WHERE i < n),
 f AS (SELECT c_custkey, (xor(h, CAST(0 AS BIGINT)) * 16777619) & 4294967295 AS h FROM s WHERE i = n)
 SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 100 ELSE h % 10007 END AS hue_step, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE (h // 10007) % 4001 END AS saturation_step, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE (h // 40038007) % 4001 END AS value_step FROM f"""
)
def overridden_colours(spark, d):
    """A colour that was set for an id counts before its default."""
    c = F.col("c_custkey")
    override = F.when(c % 4 == 0, F.struct((c % 100).cast("long").alias("hue_step"), F.lit(1).cast("long").alias("saturation_step"), F.lit(2).cast("long").alias("value_step")))
    return fx.table(spark, d, "customer").select("c_custkey", *Q.shown_colour(override, F.col("c_name")))
