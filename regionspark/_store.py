"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet under spark.checkpoint.dir and read back: lineage ends here, lost executors cost one stage.

    Only a local session without that setting gets a temporary folder. The
    files go when the session's JVM ends. Files of numbers are many times smaller
    than their rows, so the table asks not to be broadcast by its size on disk.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="regionspark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """df's rows dealt evenly over tasks, several a core: small files of keys make one task, whatever each row costs later."""
    return df.repartition(tasks(df.sparkSession))


def tasks(spark: SparkSession) -> int:
    """How many tasks long work is dealt over."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def expanded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (l_class, r_class, ...) of classes (class, member) as pairs of members: columns l, r and those of pairs.

    A class's members come in lists of some 256, so no row grows with a class,
    and pairs are written out by the tasks that need no further shuffle.
    """
    n = classes.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / 256).alias("__lists"))
    dealt = classes.join(n.hint("merge"), "class").withColumn("__list", F.pmod(F.xxhash64("member"), "__lists"))
    lists = stored(dealt.groupBy("class", "__list").agg(F.collect_list("member").alias("members")).drop("__list"), "members")
    side = lambda s: lists.select(F.col("class").alias(f"{s}_class"), F.col("members").alias(f"__{s}"))
    both = spread(pairs.join(side("l"), "l_class").join(side("r"), "r_class"))
    return both.withColumn("l", F.explode("__l")).withColumn("r", F.explode("__r")).drop("__l", "__r")
