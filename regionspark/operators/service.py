"""Answers of the read service as DataFrames: listings, readiness, conditional responses, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.requests import accepts_gzip, etag_matches
from .validate import LODS, lod_rank

PUBLIC = ("id", "name", "parent_id", "level", "neighbor_ids", "lossy")
#: HTTP status and whether it may be retried, by error code (fixed values).
ERRORS = [
    ("dataset_not_found", 404),
    ("no_current_revision", 404),
    ("revision_not_found", 404),
    ("territory_not_found", 404),
    ("revision_gone", 410),
    ("revision_corrupted", 500),
    ("invalid_bbox", 400),
    ("invalid_lod", 400),
    ("missing_lod", 422),
    ("invalid_cursor", 400),
    ("cursor_filter_mismatch", 400),
    ("limit_too_large", 400),
    ("batch_too_large", 400),
]


def datasets(pointers: DataFrame, levels: DataFrame) -> DataFrame:
    """dataset, revision_id, published_at, territory_count of the current revisions; those without a high level are left out."""
    high = levels.where("lod = 'high'").select("dataset", "revision_id", "territory_count")
    return pointers.join(high, ["dataset", "revision_id"]).select("dataset", "revision_id", "published_at", "territory_count")


def dataset_levels(levels: DataFrame) -> DataFrame:
    """One row a revision: its levels in order as an array of structs, and the finest one's bounds."""
    row = F.struct(lod_rank(F.col("lod")).alias("rank"), "lod", "territory_count", "vertices", "triangles", "bytes")
    out = levels.groupBy("dataset", "revision_id").agg(F.array_sort(F.collect_list(row)).alias("levels"), *[F.max(F.when(F.col("lod") == "high", F.col(c))).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    return out.withColumn("levels", F.transform("levels", lambda x: x.dropFields("rank")))


def not_ready(required: DataFrame, pointers: DataFrame, levels: DataFrame) -> DataFrame:
    """Required datasets without a current revision of three levels."""
    n = levels.where(F.col("lod").isin(*LODS)).groupBy("dataset", "revision_id").agg(F.count_distinct("lod").alias("n")).where(F.col("n") == len(LODS))
    return required.select("dataset").distinct().join(pointers.join(n, ["dataset", "revision_id"], "left_semi"), "dataset", "left_anti")


def mesh_responses(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """request_id, status, encoding, etag, body_bytes of conditional requests for one mesh each.

    asked: request_id, id, if_none_match, accept_encoding, head; entries: id,
    byte_length, etag, gzip_length, gzip_etag (null if there is no such variant).
    """
    r = asked.join(entries.withColumn("__known", F.lit(True)), "id", "left")
    zipped = accepts_gzip(F.coalesce("accept_encoding", F.lit(""))) & F.col("gzip_etag").isNotNull()
    r = r.withColumn("etag", F.when(zipped, F.col("gzip_etag")).otherwise(F.col("etag"))).withColumn("encoding", F.when(zipped, "gzip").otherwise("identity"))
    status = F.when(F.col("__known").isNull(), 404).when(etag_matches(F.col("if_none_match"), F.col("etag")), 304).otherwise(200)
    length = F.when(F.col("encoding") == "gzip", F.col("gzip_length")).otherwise(F.col("byte_length"))
    r = r.withColumn("status", status)
    body = F.when((F.col("status") == 200) & ~F.col("head"), length).otherwise(0)
    return r.select("request_id", "status", F.when(F.col("status") != 404, F.col("encoding")).alias("encoding"), "etag", body.alias("body_bytes"))


def safety_verdict(levels: DataFrame) -> DataFrame:
    """lod, verdict, reasons: whether clicks on a level can be trusted.

    levels: lod, lossy, topology_changed, picking_unsafe, fallback_lod. An
    absent flag makes the verdict unknown.
    """
    known = F.col("picking_unsafe").isNotNull() & F.col("lossy").isNotNull() & F.col("topology_changed").isNotNull()
    reasons = F.array_compact(
        F.array(F.when(F.col("lossy"), "parts of the source are missing"), F.when(F.col("topology_changed"), "parts were merged, split or made"), F.when(F.col("picking_unsafe") & F.col("fallback_lod").isNotNull(), F.concat(F.lit("ask level "), "fallback_lod")))
    )
    verdict = F.when(~known, "unknown").when(F.col("picking_unsafe"), "unsafe").otherwise("safe")
    return levels.select("lod", verdict.alias("verdict"), F.concat_ws("; ", F.when(known, reasons)).alias("reasons"))


def error_codes(spark) -> DataFrame:
    return spark.createDataFrame(ERRORS, "code string, status int")


def as_errors(failures: DataFrame) -> DataFrame:
    """failures (code, ...) with the status of each code; a code that is not known is an internal error, 500, and is not shown."""
    known = failures.join(F.broadcast(error_codes(failures.sparkSession)), "code", "left")
    return known.withColumn("code", F.when(F.col("status").isNull(), "internal_error").otherwise(F.col("code"))).withColumn("status", F.coalesce("status", F.lit(500)))


def missing_from_cache(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """What a read-through cache still has to fetch."""
    return wanted.join(cached, ["dataset", "revision_id", "lod", "id"], "left_anti")
