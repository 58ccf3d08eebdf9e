"""Regions, ledgers, files and ticks derived from the star-schema tables, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._store import spread
from ..functions import projection as P
from ..functions import rings as R


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key) -> F.Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), 6, "0"))


def territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, level, lon0, lat0, w, h: nations (level 1) in regions, customers and suppliers (level 2) in nations."""
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    corner = lambda k: (26 + 4 * (k % 5).cast("double"), 36 + ((k - k % 5) / 5).cast("double"))
    k = F.col("n_nationkey")
    nation = n.select(_id("n:", k).alias("id"), _id("r:", F.col("n_regionkey")).alias("parent_id"), F.lit(1).alias("level"), corner(k)[0].alias("lon0"), corner(k)[1].alias("lat0"), F.lit(4.0).alias("w"), F.lit(1.0).alias("h"))

    def leaf(df, prefix, key, nation_key):
        v, k = F.col(key), F.col(nation_key)
        lon, lat = corner(k)
        x = 0.5 * ((v * 7) % 8).cast("double")
        # 1,024 places a nation, so that few regions share one at the scales that there are; ends have nine decimals at most
        y = (((v - v % 8) / 8) % 128).cast("double") / 128
        return df.select(_id(prefix, v).alias("id"), _id("n:", k).alias("parent_id"), F.lit(2).alias("level"), (lon + x).alias("lon0"), (lat + y).alias("lat0"), F.lit(0.5).alias("w"), F.lit(1 / 128).alias("h"))

    return nation.unionByName(leaf(c, "c:", "c_custkey", "c_nationkey")).unionByName(leaf(s, "s:", "s_suppkey", "s_nationkey"))


TERRITORIES_SQL = """
terr AS (
  SELECT 'n:' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS id, 'r:' || lpad(CAST(n_regionkey AS VARCHAR), 6, '0') AS parent_id, 1 AS level,
         26 + 4 * CAST(n_nationkey % 5 AS DOUBLE) AS lon0, 36 + CAST(n_nationkey // 5 AS DOUBLE) AS lat0, CAST(4 AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS h FROM nation
  UNION ALL
  SELECT 'c:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0'), 'n:' || lpad(CAST(c_nationkey AS VARCHAR), 6, '0'), 2,
         26 + 4 * CAST(c_nationkey % 5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST((c_custkey * 7) % 8 AS DOUBLE),
         36 + CAST(c_nationkey // 5 AS DOUBLE) + CAST((c_custkey // 8) % 128 AS DOUBLE) / 128, CAST(0.5 AS DOUBLE), CAST(1 AS DOUBLE) / 128 FROM customer
  UNION ALL
  SELECT 's:' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), 'n:' || lpad(CAST(s_nationkey AS VARCHAR), 6, '0'), 2,
         26 + 4 * CAST(s_nationkey % 5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST((s_suppkey * 7) % 8 AS DOUBLE),
         36 + CAST(s_nationkey // 5 AS DOUBLE) + CAST((s_suppkey // 8) % 128 AS DOUBLE) / 128, CAST(0.5 AS DOUBLE), CAST(1 AS DOUBLE) / 128 FROM supplier),
org AS (SELECT (min(lon0) + max(lon0 + w)) / 2 AS olon, (min(lat0) + max(lat0 + h)) / 2 AS olat FROM terr),
merc AS (SELECT t.*, olon, olat, cos(radians(olat)) AS sc, 6378137.0::DOUBLE * radians(olon) AS ox, 6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(olat) / 2)) AS oy FROM terr t CROSS JOIN org),
boxes AS (SELECT id, parent_id, level,
   (6378137.0::DOUBLE * radians(lon0) - ox) * sc AS min_x, (6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(lat0) / 2)) - oy) * sc AS min_y,
   (6378137.0::DOUBLE * radians(lon0 + w) - ox) * sc AS max_x, (6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(lat0 + h) / 2)) - oy) * sc AS max_y FROM merc)
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, level, min_x, min_y, max_x, max_y in local metres; the origin is one broadcast row."""
    t = territories(spark, sf_dir)
    both = t.crossJoin(F.broadcast(P.dataset_origin(t)))
    lon, lat = F.col("origin_lon"), F.col("origin_lat")
    return both.select(
        "id",
        "parent_id",
        "level",
        P.project_x(F.col("lon0"), lon, lat).alias("min_x"),
        P.project_y(F.col("lat0"), lat).alias("min_y"),
        P.project_x(F.col("lon0") + F.col("w"), lon, lat).alias("max_x"),
        P.project_y(F.col("lat0") + F.col("h"), lat).alias("max_y"),
    )


def geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """territory, geometry in degrees: a box; a hole if its number divides by 3, a second part if by 5."""
    t = spread(territories(spark, sf_dir)).withColumn("key", F.substring("id", 3, 6).cast("int"))
    x, y, w, h = (F.col(c) for c in ("lon0", "lat0", "w", "h"))
    outer = R.box_ring(x, y, x + w, y + h)
    hole = F.reverse(R.box_ring(x + w / 4, y + h / 4, x + w / 2, y + h / 2))
    first = F.when(F.col("key") % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    second = F.array(R.box_ring(x + w, y + h, x + w * 1.25, y + h * 1.25))
    return t.select(F.col("id").alias("territory"), F.when(F.col("key") % 5 == 0, F.array(first, second)).otherwise(F.array(first)).alias("geometry"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """territory, part, ring, points of geometries()."""
    g = geometries(spark, sf_dir).select("territory", F.posexplode("geometry").alias("part", "p"))
    return g.select("territory", "part", F.posexplode("p").alias("ring", "points"))


RINGS_SQL = """
keyed AS (SELECT *, CAST(substr(id, 3, 6) AS INTEGER) AS key FROM terr),
rects AS (
  SELECT id AS territory, 0 AS part, 0 AS ring, lon0 AS x0, lat0 AS y0, lon0 + w AS x1, lat0 + h AS y1 FROM keyed
  UNION ALL SELECT id, 0, 1, lon0 + w / 4, lat0 + h / 4, lon0 + w / 2, lat0 + h / 2 FROM keyed WHERE key % 3 = 0
  UNION ALL SELECT id, 1, 0, lon0 + w, lat0 + h, lon0 + w * 1.25::DOUBLE, lat0 + h * 1.25::DOUBLE FROM keyed WHERE key % 5 = 0),
verts AS (
  SELECT territory, part, ring, 0 AS c, x0 AS x, y0 AS y FROM rects UNION ALL SELECT territory, part, ring, 1, x1, y0 FROM rects
  UNION ALL SELECT territory, part, ring, 2, x1, y1 FROM rects UNION ALL SELECT territory, part, ring, 3, x0, y1 FROM rects),
edges AS (
  SELECT a.territory, a.part, a.ring, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y,
         printf('%.9f,%.9f', a.x + 0.0, a.y + 0.0) AS ka, printf('%.9f,%.9f', b.x + 0.0, b.y + 0.0) AS kb
  FROM verts a JOIN verts b ON a.territory = b.territory AND a.part = b.part AND a.ring = b.ring AND b.c = (a.c + 1) % 4),
keys AS (SELECT *, least(ka, kb) || ';' || greatest(ka, kb) AS edge FROM edges)
"""


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from lineitem: territory, seq, stage, kind, count, area, details."""
    li = table(spark, sf_dir, "lineitem")
    from ..operators.ledger import KINDS, STAGES

    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int"))
    return li.select(
        _id("n:", F.col("l_suppkey") % 25).alias("territory"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        pick(STAGES, F.col("l_orderkey")).alias("stage"),
        pick([k[0] for k in KINDS], F.col("l_partkey")).alias("kind"),
        (F.col("l_linenumber") % 4).cast("long").alias("count"),
        F.floor(F.col("l_extendedprice")).cast("double").alias("area"),
        F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("details"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera ticks from events: session, seq, zoom, box."""
    e = table(spark, sf_dir, "events")
    x = (F.col("event_id") % 50).cast("double") * 10
    y = (F.col("event_id") % 20).cast("double") * 10
    return e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), (F.floor("value") * 500).cast("double").alias("zoom"), x.alias("min_x"), y.alias("min_y"), (x + 100).alias("max_x"), (y + 60).alias("max_y"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Served requests from events: route, status, ms, ts, request_id, hit."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 10 == 0, 404).when(F.col("event_id") % 7 == 0, 304).otherwise(200)
    return e.select(F.col("event_type").alias("route"), status.alias("status"), F.col("value").alias("ms"), "ts", F.col("event_id").alias("request_id"), (F.col("event_id") % 3 == 0).alias("hit"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level reports of made-up datasets, one per part, with flaws here and there: dataset, lod, k and their numbers."""
    p, k = F.col("p_partkey"), F.col("k")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array(*[F.lit(x) for x in ("high", "medium", "low")])).alias("k", "lod"))
    flaw = lambda m, at: ((p % m == 0) & (k == at)).cast("int")
    rows = rows.withColumn("vertices", F.floor((p % 50 + 10) * 100 / (k * (p % 4 + 1) + 1)).cast("long")).where(~((p % 29 == 0) & (k == 1)))
    return rows.select(
        p.alias("dataset"),
        "lod",
        "k",
        (flaw(11, 1) + 5).alias("territory_count"),
        "vertices",
        F.when(flaw(37, 2) == 1, 0).otherwise(F.col("vertices") - 2).alias("triangles"),
        (F.col("vertices") * 14).alias("bytes"),
        F.lit(3).alias("source_parts"),
        (3 - flaw(13, 0)).alias("parts"),
        F.lit(1).alias("source_holes"),
        (1 + flaw(17, 1)).alias("holes"),
        ((p % 19) * 600).cast("double").alias("largest_dropped"),
        ((p % 23) * 2500).cast("double").alias("dropped_area"),
    )


LEVELS_SQL = """
lv AS (SELECT p AS dataset, lod, k, 5 + CASE WHEN p % 11 = 0 AND k = 1 THEN 1 ELSE 0 END AS territory_count, v AS vertices, CASE WHEN p % 37 = 0 AND k = 2 THEN 0 ELSE v - 2 END AS triangles, v * 14 AS bytes,
  3 AS source_parts, 3 - CASE WHEN p % 13 = 0 AND k = 0 THEN 1 ELSE 0 END AS parts, 1 AS source_holes, 1 + CASE WHEN p % 17 = 0 AND k = 1 THEN 1 ELSE 0 END AS holes,
  CAST((p % 19) * 600 AS DOUBLE) AS largest_dropped, CAST((p % 23) * 2500 AS DOUBLE) AS dropped_area
  FROM (SELECT p_partkey AS p, k, lod, CAST(((p_partkey % 50 + 10) * 100) // (k * (p_partkey % 4 + 1) + 1) AS BIGINT) AS v FROM part CROSS JOIN (VALUES (0, 'high'), (1, 'medium'), (2, 'low')) t(k, lod)) WHERE NOT (p % 29 = 0 AND k = 1))
"""
