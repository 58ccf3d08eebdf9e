"""Running sums without one task a group: ranges first, then sums over ranges, then windows inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._store import stored


def running_sum(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], value: str, before: str = "before", total: str = "total") -> DataFrame:
    """df with `before` (the sum of value over the rows of the same `by` that come earlier in order) and `total` (over all of them).

    Rows are sorted by range, so even one group that holds most rows is spread
    over all tasks; ranges are numbered in the order of their keys. order must tell rows of a group apart, or equal ones lie in any order.
    """
    ranged = df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    sums = ranged.groupBy(*by, "__range").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # a group has as many rows here as ranges it reaches into
    base = sums.select(*by, "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"), F.sum("__sum").over(Window.partitionBy(*by)).alias(total))
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    a, b = own.alias("a"), base.alias("b")
    same = F.col("a.__range") == F.col("b.__range")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same).select(*[F.col(f"a.{c}").alias(c) for c in df.columns], (F.col("a.__in") + F.col("b.__base")).alias(before), F.col(f"b.{total}").alias(total))
