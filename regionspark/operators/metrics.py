"""Request metrics: counts by route and status, percentiles of each route's latest samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.requests import nearest_rank

WINDOW = 1000


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("route", "status").agg(F.count(F.lit(1)).alias("n"))


def latest(requests: DataFrame, window: int = WINDOW) -> DataFrame:
    """The newest `window` samples of each route (route, ts, ms, request_id); equal times by id."""
    n = F.row_number().over(Window.partitionBy("route").orderBy(F.desc("ts"), F.desc("request_id")))
    return requests.withColumn("n", n).where(F.col("n") <= window).drop("n")


def latency(requests: DataFrame, window: int = WINDOW) -> DataFrame:
    """route, n, p50, p95, p99 over the latest samples, by nearest rank; routes without samples have no row.

    What is gathered of a route is `window` numbers at most.
    """
    values = latest(requests, window).groupBy("route").agg(F.collect_list("ms").alias("v"))
    return values.select("route", F.size("v").alias("n"), *[nearest_rank(F.col("v"), p / 100).alias(f"p{p}") for p in (50, 95, 99)])


def cache_counts(requests: DataFrame) -> DataFrame:
    """Hits and misses over rows with a boolean `hit`."""
    return requests.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
