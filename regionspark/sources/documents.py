"""Region documents (GeoJSON feature collections, zone lists) as one DataFrame of territories."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rings import GEOMETRY, POINT, interior_area, polygon_area
from ..operators.overlay import ring_faults, surfaces

#: Properties that may name or identify a feature, in order (fixed values).
ID_KEYS = ("shapeID", "id", "ID", "shapeISO", "ISO", "iso")
NAME_KEYS = ("shapeName", "name", "NAME", "shapeISO")


class DatasetError(ValueError):
    """A document that cannot be loaded."""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, doc (variant) of whole JSON files; a file that is not a JSON object is an error when it is read."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    doc = F.try_parse_json("value")
    bad = doc.isNull() | ~F.schema_of_variant(doc).startswith("OBJECT")
    return raw.select("file", F.when(bad, F.raise_error(F.concat(F.lit("not a JSON object: "), "file")).cast("variant")).otherwise(doc).alias("doc"))


def detect_format(doc: Column) -> Column:
    """'geojson', 'zones' or null, by shape."""
    features = F.try_variant_get(doc, "$.features", "array<variant>").isNotNull()
    zones = F.try_variant_get(doc, "$.zones", "array<variant>").isNotNull()
    return F.when((F.try_variant_get(doc, "$.type", "string") == "FeatureCollection") & features, "geojson").when(zones, "zones")


def _first_text(properties: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.try_variant_get(properties, f"$.{k}", "string"), F.lit("")) for k in keys])


def _geometry(g: Column) -> Column:
    """Polygon or MultiPolygon as an array of parts of rings of struct(x, y); null for anything else."""
    kind = F.try_variant_get(g, "$.type", "string")
    deep = F.when(kind == "Polygon", F.array(F.try_variant_get(g, "$.coordinates", "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.try_variant_get(g, "$.coordinates", "array<array<array<array<double>>>>"))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")).cast(POINT)
    return F.transform(deep, lambda part: F.transform(part, lambda ring: F.transform(ring, point))).cast(GEOMETRY)


def load_geojson(docs: DataFrame) -> DataFrame:
    """A row per feature: dataset, pos, id, name, level, parent_id, geometry, properties."""
    name = F.regexp_replace("file", r"\.[^.]*$", "")
    d = docs.where(detect_format(F.col("doc")) == "geojson")
    d = d.select(F.coalesce(F.try_variant_get("doc", "$.metadata.id", "string"), name).alias("dataset"), F.posexplode(F.try_variant_get("doc", "$.features", "array<variant>")).alias("pos", "f"))
    p = F.try_variant_get("f", "$.properties", "variant")
    d = d.select("dataset", "pos", F.coalesce(_first_text(p, ID_KEYS), F.concat_ws("-", "dataset", F.col("pos").cast("string"))).alias("id"), _first_text(p, NAME_KEYS).alias("n"), "f", p.alias("properties"))
    return d.select(
        "dataset", "pos", "id", F.coalesce("n", "id").alias("name"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("parent_id"), _geometry(F.try_variant_get("f", "$.geometry", "variant")).alias("geometry"), "properties"
    )


def parents(zones: DataFrame) -> DataFrame:
    """zones (dataset, pos, id, child_ids) -> dataset, id, parent_id; of several zones naming a child the last counts."""
    c = zones.select("dataset", F.col("id").alias("parent"), "pos", F.posexplode("child_ids").alias("k", "id")).where("id is not null")
    return c.groupBy("dataset", "id").agg(F.max_by("parent", F.struct("pos", "k")).alias("parent_id"))


def load_zones(docs: DataFrame) -> DataFrame:
    """A row per zone, as load_geojson has them."""
    name = F.regexp_replace("file", r"\.[^.]*$", "")
    d = docs.where(detect_format(F.col("doc")) == "zones")
    d = d.select(F.coalesce(F.try_variant_get("doc", "$.manifest.datasetId", "string"), name).alias("dataset"), F.posexplode(F.try_variant_get("doc", "$.zones", "array<variant>")).alias("pos", "z"))
    given = F.nullif(F.try_variant_get("z", "$.id", "string"), F.lit(""))
    d = d.select("dataset", "pos", F.coalesce(given, F.raise_error("a zone has no id").cast("string")).alias("id"), F.try_variant_get("z", "$.childIds", "array<string>").alias("child_ids"), "z")
    out = d.join(parents(d.select("dataset", "pos", "id", "child_ids")), ["dataset", "id"], "left")
    p = F.try_variant_get("z", "$.properties", "variant")
    return out.select(
        "dataset", "pos", "id", F.coalesce(F.nullif(F.try_variant_get(p, "$.name", "string"), F.lit("")), "id").alias("name"), F.try_variant_get("z", "$.level", "int").alias("level"), "parent_id", _geometry(F.try_variant_get("z", "$.geometry", "variant")).alias("geometry"), p.alias("properties")
    )


def load(spark: SparkSession, path: str) -> DataFrame:
    docs = read_documents(spark, path)
    return load_geojson(docs).unionByName(load_zones(docs))


def duplicate_ids(territories: DataFrame) -> DataFrame:
    return territories.groupBy("dataset", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def geometry_problems(territories: DataFrame) -> DataFrame:
    """dataset, id, problem of geometries that are missing, empty, not finite, too short or without area."""
    g = F.col("geometry")
    points = F.flatten(F.flatten(g))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    area = F.aggregate(F.transform(g, polygon_area), F.lit(0.0), lambda a, b: a + b)
    problem = (
        F.when(g.isNull(), "missing_or_unsupported")
        .when((F.size(g) == 0) | F.exists(g, lambda p: F.size(p) == 0), "empty")
        .when(F.exists(points, lambda p: odd(p["x"]) | odd(p["y"])), "not_finite")
        .when(F.exists(F.flatten(g), lambda r: F.size(r) < 4), "short_ring")
        .when(area <= 0, "no_area")
    )
    return territories.select("dataset", "id", problem.alias("problem"), interior_area(g).alias("hole_area")).where("problem is not null").drop("hole_area")


def _crosses(ring: np.ndarray) -> bool:
    """Whether edges of a closed ring cross or touch other than at their common ends: a sweep over edges by their left end."""
    a, b = ring[:-1], ring[1:]
    n = len(a)
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 0], kind="stable")
    starts = low[order, 0]
    ends = np.searchsorted(starts, high[order, 0], side="right")
    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    for k in range(n):
        i = order[k]
        j = order[k + 1 : ends[k]]
        j = j[(low[j, 1] <= high[i, 1]) & (high[j, 1] >= low[i, 1])]
        gap = np.abs(j - i)
        near = (gap == 1) | (gap == n - 1)
        far = j[~near]
        if len(far):
            s1, s2 = side(a[i], b[i], a[far]), side(a[i], b[i], b[far])
            s3, s4 = side(a[far], b[far], a[i]), side(a[far], b[far], b[i])
            if ((s1 * s2 <= 0) & (s3 * s4 <= 0)).any():
                return True
        for m in j[near].tolist():  # neighbours may only fold back on each other
            p, q = (i, m) if (i + 1) % n == m else (m, i)
            if n > 2 and side(a[p], b[p], b[q]) == 0 and float((a[p] - b[p]) @ (b[q] - b[p])) > 0:
                return True
    return False


def self_crossing(territories: DataFrame) -> DataFrame:
    """dataset, id, part, ring of rings that cross or touch themselves, such as bow ties; rows are rings, so work spreads."""
    rings = territories.select("dataset", "id", F.posexplode("geometry").alias("part", "p")).select("dataset", "id", "part", F.posexplode("p").alias("ring", "points"))

    def run(batches):
        for b in batches:
            keep = [_crosses(np.array([(p["x"], p["y"]) for p in r], float)) if r and len(r) > 3 else False for r in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(list(b.columns[:4]), names=["dataset", "id", "part", "ring"]).filter(pa.array(keep, pa.bool_()))

    return rings.mapInArrow(run, "dataset string, id string, part int, ring int")


def _rings(territories: DataFrame) -> DataFrame:
    """territory (dataset and id), part, ring, points."""
    parts = territories.select(F.struct("dataset", "id").alias("territory"), F.posexplode("geometry").alias("part", "p"))
    return parts.select("territory", "part", F.posexplode("p").alias("ring", "points"))


def faults(territories: DataFrame) -> DataFrame:
    """dataset, id, part, ring, fault of rings that cross themselves or each other or lie where they may not (overlay.ring_faults)."""
    return ring_faults(_rings(territories)).select("territory.dataset", "territory.id", "part", "ring", "fault")


def require_valid(territories: DataFrame) -> DataFrame:
    """The territories, or an error that names the first bad ones: duplicates, unusable geometries, faults of rings."""
    _require_usable(territories)
    said = {"self_crossing": "crosses itself", "rings_cross": "rings cross", "hole_outside": "a hole lies outside", "nested_holes": "a hole lies in another", "parts_overlap": "parts overlap"}
    bad = [f"{r.dataset}/{r.id}: {said[r.fault]} ({r.fault})" for r in faults(territories).orderBy("dataset", "id", "fault").limit(10).collect()]
    if bad:
        raise DatasetError("; ".join(bad))
    return territories


def _require_usable(territories: DataFrame) -> None:
    """No policy loads these: geometries that are missing, empty, not finite or short, and ids that are there twice."""
    bad = [f"{r.dataset}/{r.id}: {r.problem}" for r in geometry_problems(territories).where("problem <> 'no_area'").limit(10).collect()]
    bad += [f"{r.dataset}/{r.id}: duplicate id" for r in duplicate_ids(territories).limit(10).collect()]
    if bad:
        raise DatasetError("; ".join(bad))


def repair(territories: DataFrame) -> DataFrame:
    """The territories with a column `repaired`; those with faulty rings get the even-odd surface of their rings.

    Their parts are numbered by decreasing area and hold closed rings; spikes,
    lines and points are gone. Sound territories keep their geometry as it is.
    A territory without a surface, faulty or flat, is an error when its row is read.
    """
    territory = F.struct("dataset", "id")
    bad = faults(territories).select(territory.alias("grp")).distinct()
    rings = _rings(territories).withColumnRenamed("territory", "grp").join(bad, "grp", "left_semi")
    closed = F.transform("rings", lambda r: F.concat(r, F.slice(r, 1, 1)))
    parts = surfaces(rings.select("grp", "points")).select("grp", F.struct((-F.col("area")).alias("a"), closed.alias("part")).alias("p"))
    made = parts.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]).alias("made"))
    found = territories.join(bad.join(made, "grp", "left").select("grp.dataset", "grp.id", F.lit(True).alias("repaired"), "made"), ["dataset", "id"], "left")
    g = F.when(F.col("repaired"), F.col("made")).otherwise(F.col("geometry"))
    area = F.aggregate(F.transform(g, polygon_area), F.lit(0.0), lambda a, b: a + b)
    lost = F.raise_error(F.concat(F.lit("no usable surface: "), F.col("dataset"), F.lit("/"), F.col("id"))).cast(GEOMETRY)
    out = found.withColumn("geometry", F.when(area > 0, g).otherwise(lost)).withColumn("repaired", F.coalesce("repaired", F.lit(False)))
    return out.select(*territories.columns, "repaired")


def load_dataset(spark: SparkSession, path: str, on_invalid: str = "reject") -> DataFrame:
    """The territories of all documents under path, and whether each was repaired.

    on_invalid "reject": any fault is an error; "repair": faulty geometries are rebuilt, which changes their shape.
    """
    if on_invalid not in ("reject", "repair"):
        raise ValueError(f"on_invalid is 'reject' or 'repair', not {on_invalid!r}")
    found = load(spark, path)
    if on_invalid == "reject":
        return require_valid(found).withColumn("repaired", F.lit(False))
    _require_usable(found)
    return repair(found)
