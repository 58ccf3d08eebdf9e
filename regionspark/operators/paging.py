"""Keyset pages over entries in id order, with a bound on how many are looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_DEFAULT, PAGE_MAX, SCAN_CAP = 50, 500, 5000


def _looked_at(entries: DataFrame, predicate: Column, limit: int, after: str | None, scan_cap: int) -> DataFrame:
    """The first scan_cap + 1 entries after `after`, with __hit and __looked (whether the page got to them)."""
    if not 1 <= limit <= PAGE_MAX:
        raise ValueError(f"limit must be 1 to {PAGE_MAX}: {limit}")
    rest = entries if after is None else entries.where(F.col("id") > after)
    seen = rest.withColumn("__hit", F.coalesce(predicate, F.lit(False))).orderBy("id").limit(scan_cap + 1)
    order = Window.orderBy("id")  # over scan_cap + 1 rows at most
    before = F.coalesce(F.sum(F.col("__hit").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return seen.withColumn("__looked", (F.row_number().over(order) <= scan_cap) & (before < limit))


def paginate(entries: DataFrame, predicate: Column, limit: int = PAGE_DEFAULT, after: str | None = None, scan_cap: int = SCAN_CAP) -> DataFrame:
    """The rows of a page.

    Entries are looked at in id order after `after`, until `limit` of them match
    or `scan_cap` have been looked at. The seek is a pushed-down filter, and only
    scan_cap + 1 entries leave the scan (a top-k, no global sort).
    """
    return _looked_at(entries, predicate, limit, after, scan_cap).where("__looked and __hit").drop("__hit", "__looked")


def page_info(entries: DataFrame, predicate: Column, limit: int = PAGE_DEFAULT, after: str | None = None, scan_cap: int = SCAN_CAP) -> DataFrame:
    """One row: ids of the page, last_scanned_id, has_more, scan_truncated - also of a page without matches.

    A next page exists if has_more; scan_truncated says that the cap, not the
    limit, ended this one.
    """
    seen = _looked_at(entries, predicate, limit, after, scan_cap)
    out = seen.agg(
        F.sort_array(F.collect_list(F.when(F.col("__looked") & F.col("__hit"), F.col("id")))).alias("ids"),
        F.max(F.when(F.col("__looked"), F.col("id"))).alias("last_scanned_id"),
        F.coalesce(F.bool_or(~F.col("__looked")), F.lit(False)).alias("has_more"),
    )
    return out.withColumn("scan_truncated", F.col("has_more") & (F.size("ids") < limit))
