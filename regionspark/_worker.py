"""Small session helpers of the library."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
